"""Transcribed chunks merged to one timeline, frame selection, and run snapshots.

The order-dependent steps stream sorted rows through one fold, so that a medium of any
length is never held in memory.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters that a boundary comparison ignores.
IGNORED = re.compile(r"[\s，。！？、,.!?]")
SHORTEST, LONGEST = 8, 160
#: Event types that end a run, and the state in which they leave it.
ENDS = {"completed": "completed", "error": "failed", "cancelled": "cancelled"}


def chunk_timeline(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments (media_id, chunk, ord, start_ms, end_ms, text; times within the chunk) on
    the clock of their medium: media_id, chunk, ord, start_ms, end_ms, text, precision,
    out_of_range. A chunk without any time gets its bounds on its first and last segment.
    `chunks` is media_id, chunk, first_ms, last_ms, overlap_ms, duration_ms."""
    each = Window.partitionBy("media_id", "chunk")
    timed = F.max(F.col("start_ms").isNotNull()).over(each)
    joined = segments.join(chunks, ["media_id", "chunk"]).select("*", timed.alias("timed"), (F.col("ord") == F.min("ord").over(each)).alias("opens"), (F.col("ord") == F.max("ord").over(each)).alias("closes"))
    start = F.when(F.col("timed"), F.col("first_ms") + F.col("start_ms")).when(F.col("opens"), F.col("first_ms") + F.col("overlap_ms"))
    end = F.when(F.col("timed"), F.col("first_ms") + F.col("end_ms")).when(F.col("closes"), F.col("last_ms"))
    return joined.select(
        "media_id", "chunk", "ord", start.alias("start_ms"), end.alias("end_ms"), "text", F.when(F.col("timed"), "segment").otherwise("chunk").alias("precision"),
        F.coalesce(start > F.col("duration_ms") + 1000, F.lit(False)).alias("out_of_range"),
    )


def boundary(left: str, right: str) -> int:
    """Length of the longest end of `left` that opens `right`, marks and case aside."""
    plain = [IGNORED.sub("", x).lower() for x in (left[-LONGEST:], right[:LONGEST])]
    for n in range(min(LONGEST, len(left), len(right)), SHORTEST - 1, -1):
        if plain[0].endswith(mark := IGNORED.sub("", right[:n]).lower()) and mark == IGNORED.sub("", left[-n:]).lower():
            return n
    return 0


def drop_overlaps(timeline: DataFrame) -> DataFrame:
    """The timeline without text repeated across neighbouring segments; segments of which
    nothing is left go. Null texts are empty."""
    columns = ["media_id", "chunk", "ord", "start_ms", "end_ms", "text"]

    def run(batches):
        media = before = None
        for batch in batches:
            kept = []
            for i, (now, text) in enumerate(zip(batch.media_id, batch.text, strict=True)):
                if now != media:
                    media, before = now, None
                cut = boundary(before, text) if before is not None else 0
                text = text[cut:].lstrip() if cut else text
                if before is None or text.strip():
                    kept.append((i, text))
                    before = text
            yield batch.iloc[[i for i, _ in kept]].assign(text=[t for _, t in kept])

    rows = timeline.select(*columns[:-1], F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("media_id").sortWithinPartitions("media_id", "chunk", "ord")
    return ordered.mapInPandas(run, rows.schema)


def select_frames(frames: DataFrame, threshold: float = 0.8, gap_ms: int = 8000, limit: int = 64) -> DataFrame:
    """Useful frames (media_id, frame_id, timestamp_ms) in order of confidence, none nearer
    than `gap_ms` to one taken before, at most `limit` a medium, which is the feature.
    Only those taken are held."""
    useful = frames.where(F.col("valuable") & (F.col("category") != "talking_head") & (F.col("confidence") >= threshold))
    rows = useful.select("media_id", "frame_id", "timestamp_ms", "confidence")

    def run(batches):
        media, taken = None, []
        for batch in batches:
            picks = []
            for i, (now, at) in enumerate(zip(batch.media_id, batch.timestamp_ms, strict=True)):
                if now != media:
                    media, taken = now, []
                if len(taken) < limit and all(abs(at - t) >= gap_ms for t in taken):
                    taken.append(at)
                    picks.append(i)
            yield batch.iloc[picks]

    ordered = rows.repartition("media_id").sortWithinPartitions("media_id", F.desc("confidence"), "timestamp_ms", "frame_id")
    return ordered.mapInPandas(run, rows.schema)


def frame_id(timestamp_ms):
    """Column: the id of a frame from its time."""
    return F.concat(F.lit("frame-t"), F.lpad(timestamp_ms.cast("string"), 10, "0"))


def run_snapshots(events: DataFrame) -> DataFrame:
    """run_id, state, iterations, tools_started, tools_failed, last_seq of run events
    (run_id, seq, type, tool_call_id, iteration, is_error). The first ending event closes
    a run and later ones are ignored; text events change nothing."""
    ends = events.where(F.col("type").isin(*ENDS)).groupBy("run_id").agg(F.min("seq").alias("end_seq"), F.min_by("type", "seq").alias("end_type"))
    live = events.where("type <> 'text'").join(ends, "run_id", "left").where("end_seq IS NULL OR seq <= end_seq")
    states = F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])
    tool = F.col("tool_call_id")
    return live.groupBy("run_id").agg(
        F.coalesce(F.try_element_at(states, F.max("end_type")), F.when(F.max((F.col("type") == "plan_ready").cast("int")) == 1, "waiting").otherwise("running")).alias("state"),
        F.coalesce(F.max("iteration"), F.lit(0)).alias("iterations"),
        F.count_distinct(F.when(F.col("type").isin("tool_started", "tool_completed"), tool)).alias("tools_started"),
        F.count_distinct(F.when((F.col("type") == "tool_completed") & F.col("is_error"), tool)).alias("tools_failed"),
        F.max("seq").alias("last_seq"),
    )


def merge_plan(timeline: DataFrame) -> DataFrame:
    """media_id, n_segments, first_ms, last_ms, precision, out_of_range of whole media."""
    return timeline.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.min("precision").alias("precision"), F.max("out_of_range").alias("out_of_range")
    )
