"""Timed transcripts, conversations and progress events."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

def gap_sessions(segments: DataFrame, gap_ms: int = 3000) -> DataFrame:
    """media_id, session, first and last ms, segments: a new one after a longer gap."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "ord")
    new = F.coalesce((F.col("start_ms") - F.lag("end_ms").over(order) > gap_ms).cast("int"), F.lit(0))
    marked = segments.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("media_id", "session").agg(F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.count(F.lit(1)).alias("n_segments"))


def timeline_issues(segments: DataFrame) -> DataFrame:
    """media_id, ord, code: broken times and damaged text. An optional duration_ms column
    bounds the times, with a second of grace."""
    order = Window.partitionBy("media_id").orderBy("ord")
    before = F.max("start_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    last = F.col("duration_ms") + 1000 if "duration_ms" in segments.columns else F.lit(None).cast("long")
    codes = F.array(
        F.when(F.col("text").contains("\uFFFD"), "replacement_character"),
        F.when(F.col("start_ms") < F.col("before"), "not_monotonic"),
        F.when(F.col("end_ms") < F.col("start_ms"), "ends_before_start"),
        F.when(F.coalesce(F.col("start_ms") > last, F.lit(False)) | F.coalesce(F.col("end_ms") > last, F.lit(False)), "out_of_range"),
    )
    return segments.withColumn("before", before).select("media_id", "ord", F.explode(F.array_compact(codes)).alias("code"))


_ENDING = re.compile(r"[。！？.!?][”’」』】)]?$")
_WORD_END, _WORD_START = re.compile(r"[A-Za-z0-9]$"), re.compile(r"[A-Za-z0-9]")


def join_text(left: str, right: str) -> str:
    """Two texts with a blank between them only where Latin words meet."""
    return f"{left} {right}" if _WORD_END.search(left) and _WORD_START.match(right) else left + right


class Paragraph:
    """The paragraph that a fold over ordered segments is at."""

    def __init__(self, start, end, speaker, text: str):
        self.start, self.end, self.speaker, self.text = start, end, speaker, text

    def takes(self, start, end, speaker, text: str) -> bool:
        """Whether the next segment belongs to it: no long pause, not too long with it in time
        or text, no finished sentence in a paragraph of some length, and the same speaker."""
        pause = start - self.end if self.end is not None and start is not None else 0
        lasts = end - self.start if self.start is not None and end is not None else 0
        return not (
            pause > 3000 or lasts > 45_000 or len(self.text) + len(text) > 600
            or (len(self.text) >= 160 and _ENDING.search(self.text))
            or (self.speaker and speaker and self.speaker != speaker)
        )

    def add(self, end, text: str) -> None:
        self.text = join_text(self.text, text)
        self.end = self.end if end is None else end

    def row(self) -> tuple:
        return self.start, self.end, f"**{self.speaker}：** {self.text}" if self.speaker else self.text


def paragraphs(segments: DataFrame) -> DataFrame:
    """media_id, paragraph_no, start_ms, end_ms, text. Whether a paragraph closes depends
    on what it holds, so rows stream in order through one fold per medium; only the open
    paragraph is held. Segments without text are skipped; times may be null."""
    columns = ["media_id", "paragraph_no", "start_ms", "end_ms", "text"]

    def run(batches):
        media, number, open_ = None, 0, None
        for b in batches:
            out = []
            clean = lambda x: None if x is None or x != x else int(x)
            for now, start, end, speaker, text in zip(b.media_id, b.start_ms, b.end_ms, b.speaker, b.text, strict=True):
                text = " ".join((text or "").split())
                start, end = clean(start), clean(end)
                if open_ is not None and now != media:
                    out.append((media, number, *open_.row()))
                    number, open_ = 0, None
                if now != media:
                    media, number = now, 0
                if not text:
                    continue
                if open_ is not None and open_.takes(start, end, speaker, text):
                    open_.add(end, text)
                    continue
                if open_ is not None:
                    out.append((media, number, *open_.row()))
                    number += 1
                open_ = Paragraph(start, end, speaker, text)
            yield _frame(out, columns)
        if open_ is not None:
            yield _frame([(media, number, *open_.row())], columns)

    ordered = segments.select("media_id", "ord", "start_ms", "end_ms", "speaker", "text").repartition("media_id").sortWithinPartitions("media_id", "ord")
    kind = dict(segments.dtypes)["media_id"]
    return ordered.mapInPandas(run, f"media_id {kind}, paragraph_no int, start_ms long, end_ms long, text string")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({"start_ms": "Int64", "end_ms": "Int64"})


def chunk_plan(media: DataFrame, chunk_ms: int = 900_000, overlap_ms: int = 2000) -> DataFrame:
    """media_id, index, start_ms, end_ms: chunks of a duration, overlapping but the first."""
    count = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / chunk_ms)).cast("int")
    rows = media.select("media_id", "duration_ms", F.explode(F.sequence(F.lit(0), count - 1)).alias("index"))
    start = F.greatest(F.lit(0), F.col("index").cast("long") * chunk_ms - F.when(F.col("index") > 0, overlap_ms).otherwise(0))
    return rows.select("media_id", "index", start.alias("start_ms"), F.least("duration_ms", (F.col("index").cast("long") + 1) * chunk_ms).alias("end_ms"))


def density_limit(hours, least: int, rate: int, most: int):
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(hours * rate))).cast("int")


def conversation_tail(conversations: DataFrame, last: int = 8, width: int = 4000) -> DataFrame:
    """The last turns of each conversation, long texts cut with an ellipsis."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    text = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width - 1), F.lit("…"))).otherwise(F.col("text"))
    ranked = conversations.withColumn("from_end", F.row_number().over(order)).where(F.col("from_end") <= last)
    return ranked.select("conv_id", "turn", "role", text.alias("text"), "from_end")


def context_usage(conversations: DataFrame) -> DataFrame:
    """role, turns and estimated tokens over all conversations."""
    return conversations.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


def raw_percent(phases: dict[str, tuple[int, int]], phase, completed, total):
    """Percent of one event: its phase's start plus the share done, 0 to 100. `phases` has
    the percent at the start of each phase and the percent it spans; others start at 0."""
    table = F.create_map(*[F.lit(x) for k, (a, b) in phases.items() for x in (k, a * 1000 + b)])
    code = F.coalesce(F.try_element_at(table, phase), F.lit(0))
    share = F.when((completed >= 0) & (total > 0), F.least(F.lit(1.0), completed / total)).otherwise(0.0)
    return F.least(F.lit(100.0), F.floor(F.floor(code / 1000) + (code % 1000) * share + 0.5))


def progress_percent(progress: DataFrame, phases: dict[str, tuple[int, int]], slice_rows: int = 100_000) -> DataFrame:
    """source_id, seq, percent: never falling within a source (batch form).

    The running maximum is taken within slices of `seq` and the greatest value of the slices
    before is carried in, so that a source with most events is not one task.
    """
    raw = raw_percent(phases, F.col("phase"), F.col("completed"), F.col("total"))
    rows = progress.select("source_id", "seq", raw.alias("raw"), F.floor(F.col("seq") / slice_rows).alias("slice"))
    before = Window.partitionBy("source_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("source_id", "slice").agg(F.max("raw").alias("most")).withColumn("carry", F.max("most").over(before)).drop("most")
    within = Window.partitionBy("source_id", "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("best", F.max("raw").over(within)).join(carried, ["source_id", "slice"])
    return running.select("source_id", "seq", F.greatest("best", F.coalesce("carry", F.lit(0.0))).cast("int").alias("percent"))


def latest_events(events: DataFrame) -> DataFrame:
    """user_id and the type and value of each user's last event."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("e")).select("user_id", "e.event_id", "e.event_type", "e.value")
