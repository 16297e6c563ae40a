"""Transcripts from several services, untimed text, frames beside text, captions, context."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.timeline import join_text
from lodestone.storage import bounded_batches

#: Characters of a paragraph, at most and before a sentence end closes it, and
#: what ends a sentence.
LONGEST, CLOSES = 480, 260
_STOP = re.compile(r"[。！？!?；;][”’」』】)\]]*")
_ENDS = re.compile(r"[。！？!?；;][”’」』】)\]]?$")


def _units(text: str):
    """Sentences of a collapsed text; those too long cut behind a comma or blank."""
    end = 0
    for m in _STOP.finditer(text):
        yield from _cut(text[end : m.end()].strip())
        end = m.end()
    yield from _cut(text[end:].strip())


def _cut(unit: str):
    while len(unit) > LONGEST:
        at = max(unit.rfind(mark, 0, LONGEST) for mark in "，,、 ")
        at = at + 1 if at >= 180 else LONGEST
        yield unit[:at].strip()
        unit = unit[at:].strip()
    if unit:
        yield unit


def untimed_paragraphs(text: str) -> list[str]:
    """Paragraphs of a text without times: whole sentences, packed up to LONGEST characters."""
    out, current = [], ""
    for unit in _units(" ".join(text.split())):
        both = join_text(current, unit) if current else unit
        if current and len(both) > LONGEST:
            out.append(current)
            both = unit
        current = both
        if len(current) >= CLOSES and _ENDS.search(current):
            out.append(current)
            current = ""
    return [*out, current] if current else out


def normalize_segments(segments: DataFrame) -> DataFrame:
    """media_id, ord, part, start_ms, end_ms, text: segments with collapsed text; long ones
    without any time as paragraphs, empty ones gone."""

    def run(batches):
        for b in batches:
            rows = []
            for media, ord_, start, end, text in zip(b.media_id, b.ord, b.start_ms, b.end_ms, b.text, strict=True):
                text = " ".join((text or "").split())
                timed = not (pd.isna(start) and pd.isna(end))
                parts = ([text] if text else []) if timed or len(text) <= LONGEST else untimed_paragraphs(text)
                rows += [(media, ord_, i, start, end, p) for i, p in enumerate(parts)]
            out = pd.DataFrame(rows, columns=["media_id", "ord", "part", "start_ms", "end_ms", "text"])
            yield out.astype({"start_ms": "Int64", "end_ms": "Int64"})

    kinds = dict(segments.dtypes)
    rows = segments.select("media_id", "ord", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"), "text")
    return rows.mapInPandas(run, f"media_id {kinds['media_id']}, ord {kinds['ord']}, part int, start_ms long, end_ms long, text string")


def word_groups(words: DataFrame, longest: int = 120, gap_ms: int = 1500) -> DataFrame:
    """media_id, group_no, start_ms, end_ms, speaker, text: words (media_id, ord, start_ms,
    end_ms, speaker, text) in groups; a new one once a group has `longest` characters or
    after a longer gap. Rows stream in order through one fold per medium."""
    columns = ["media_id", "group_no", "start_ms", "end_ms", "speaker", "text"]

    def run(batches):
        open_ = None
        for b in batches:
            out = []
            for media, start, end, speaker, text in zip(b.media_id, b.start_ms, b.end_ms, b.speaker, b.text, strict=True):
                text = (text or "").strip()
                if not text:
                    continue
                start, end = (None if pd.isna(x) else int(x) for x in (start, end))
                last = open_ and (open_[3] if open_[3] is not None else start)
                if open_ and open_[0] == media and len(open_[5]) < longest and (start or 0) - (last or 0) <= gap_ms:
                    open_[5], open_[3] = join_text(open_[5], text), open_[3] if end is None else end
                    continue
                if open_:
                    out.append(tuple(open_))
                open_ = [media, open_[1] + 1 if open_ and open_[0] == media else 0, start, end, speaker, text]
            yield pd.DataFrame(out, columns=columns).astype({"start_ms": "Int64", "end_ms": "Int64"})
        if open_:
            yield pd.DataFrame([tuple(open_)], columns=columns).astype({"start_ms": "Int64", "end_ms": "Int64"})

    kinds = dict(words.dtypes)
    rows = words.select("media_id", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"), "speaker", "text", "ord").repartition("media_id").sortWithinPartitions("media_id", "ord")
    return rows.mapInPandas(run, f"media_id {kinds['media_id']}, group_no int, start_ms long, end_ms long, speaker string, text string")


_ITEM = "struct<text:string,transcript:string,word:string,start_ms:double,end_ms:double,start_time:double,end_time:double,start:double,`end`:double,timestamp:array<double>,speaker:string,speaker_id:string,confidence:double,probability:double>"
_ROOT = f"struct<text:string,transcript:string,language:string,duration:double,duration_ms:double,segments:array<{_ITEM}>,utterances:array<{_ITEM}>,chunks:array<{_ITEM}>,words:array<{_ITEM}>>"


def _unwrapped(body: str) -> str:
    """The object inside data, output or result, to three levels; no JSON is a plain text."""
    try:
        root = json.loads(body)
    except ValueError:
        return json.dumps({"text": body})
    if isinstance(root, str):
        return json.dumps({"text": root})
    for _ in range(3):
        inner = next((root[k] for k in ("data", "output", "result") if isinstance(root, dict) and isinstance(root.get(k), dict)), None)
        if inner is None:
            break
        root = inner
    return json.dumps(root)


def adapt_responses(responses: DataFrame) -> DataFrame:
    """media_id, ord, start_ms, end_ms, text, speaker, confidence, from_words of service
    responses (media_id, body): JSON in any of the known shapes, within data, output or
    result to three levels. Seconds become milliseconds unless a field says so or the times
    are too large to be seconds. A response without segments gives its plain text."""

    bounded_batches(responses.sparkSession)

    def unwrap(bodies: pd.Series) -> pd.Series:
        return bodies.map(_unwrapped, na_action="ignore")

    unwrap.__annotations__ = {"bodies": pd.Series, "return": pd.Series}
    rows = responses.select("media_id", F.from_json(F.pandas_udf(unwrap, "string")("body"), _ROOT).alias("r")).select("media_id", "r.*")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    items = F.coalesce(some("segments"), some("utterances"), some("chunks"), some("words"))
    rows = rows.withColumn("from_words", F.coalesce(some("segments"), some("utterances"), some("chunks")).isNull() & some("words").isNotNull()).withColumn("items", items)
    bare = F.filter("items", lambda i: i["start_ms"].isNull() & i["end_ms"].isNull())
    most = F.array_max(F.flatten(F.transform(bare, lambda i: F.concat(F.array(i["start"], i["start_time"], i["end"], i["end_time"]), F.coalesce(i["timestamp"], F.array().cast("array<double>"))))))
    most = F.greatest(F.lit(0.0), F.coalesce(most, F.lit(0.0)))
    unit = F.when((F.col("duration") > 0) & (most > F.col("duration") * 10), 1).when(most >= 10_000, 1).otherwise(1000)
    rows = rows.withColumn("unit", unit)
    exploded = rows.select("media_id", "unit", "from_words", F.posexplode("items").alias("ord", "i"))
    scale = F.when(F.col("i.start_ms").isNotNull() | F.col("i.end_ms").isNotNull(), 1).otherwise(F.col("unit"))
    at = lambda side, n: F.round(F.coalesce(F.col(f"i.{side}_ms"), F.col(f"i.{side}_time"), F.col("i")[side], F.get("i.timestamp", n)) * scale).cast("long")
    text = F.coalesce(*[F.nullif(F.trim(F.col(f"i.{c}")), F.lit("")) for c in ("text", "transcript", "word")])
    timed = exploded.select("media_id", "ord", at("start", 0).alias("start_ms"), at("end", 1).alias("end_ms"), text.alias("text"), F.coalesce("i.speaker", "i.speaker_id").alias("speaker"), F.coalesce("i.confidence", "i.probability").alias("confidence"), "from_words").where("text IS NOT NULL")
    plain = rows.select("media_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(F.trim("transcript"), F.lit(""))).alias("text")).where("text IS NOT NULL")
    plain = plain.join(timed.select("media_id").distinct(), "media_id", "left_anti")
    none = {"ord": "int", "start_ms": "long", "end_ms": "long", "speaker": "string", "confidence": "double"}
    plain = plain.withColumns({c: F.lit(None).cast(k) for c, k in none.items()}).withColumns({"ord": F.lit(0), "from_words": F.lit(False)})
    return timed.unionByName(plain.select(timed.columns))


def transcript_warnings(segments: DataFrame) -> DataFrame:
    """media_id, code: no timestamps, little text, low mean confidence, much repetition."""
    found = segments.groupBy("media_id").agg(
        F.count("start_ms").alias("timed"), F.sum(F.length("text")).alias("characters"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("distinct"),
    )
    codes = F.array(
        F.when(F.col("timed") == 0, "TRANSCRIPT_TIMESTAMPS_MISSING"), F.when(F.col("characters") < 160, "TRANSCRIPT_SHORT"), F.when(F.col("confidence") < 0.5, "TRANSCRIPT_LOW_CONFIDENCE"),
        F.when((F.col("n") >= 10) & (F.col("distinct") / F.col("n") < 0.7), "TRANSCRIPT_REPETITION_HIGH"),
    )
    return found.select("media_id", F.explode(F.array_compact(codes)).alias("code"))


def frame_texts(frames: DataFrame, segments: DataFrame, reach_ms: int = 30_000, most: int = 6000) -> DataFrame:
    """media_id, frame_id, text: what is said within `reach_ms` of each frame, in order, cut.

    Frames and segments meet by slots of time, so that a medium of any length is no single
    group; a segment is in each slot it touches with its reach.
    """
    start, end = F.col("start_ms") - reach_ms, F.coalesce("end_ms", "start_ms") + reach_ms
    slot = lambda c: F.floor(c / reach_ms)
    said = segments.where(F.col("start_ms").isNotNull() & (F.trim("text") != "")).select("media_id", "ord", "start_ms", "end_ms", F.trim("text").alias("text"), F.explode(F.sequence(slot(start), slot(end))).alias("slot"))
    shown = frames.select("media_id", "frame_id", "timestamp_ms", slot(F.col("timestamp_ms")).alias("slot"))
    met = shown.join(said, ["media_id", "slot"]).where((F.coalesce("end_ms", "start_ms") >= F.col("timestamp_ms") - reach_ms) & (F.col("start_ms") <= F.col("timestamp_ms") + reach_ms))
    texts = met.groupBy("media_id", "frame_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " "), 1, most).alias("text"))
    return frames.select("media_id", "frame_id").join(texts, ["media_id", "frame_id"], "left").select("media_id", "frame_id", F.coalesce("text", F.lit("")).alias("text"))


def align_frames(frames: DataFrame, paragraphs: DataFrame, each: int = 2) -> DataFrame:
    """media_id, frame_id, paragraph_no: the paragraph nearest in time to each frame (the
    earlier of two), at most `each` frames a paragraph in the order of frames; null for the
    rest, which goes to an appendix.

    The nearest paragraph is the last that starts before the frame, or the next one, or one
    before that lasts longer: of those before, the one that ends last. So each frame looks up
    two rows, by a merge of both tables in order of time.
    """
    timed = paragraphs.where("start_ms IS NOT NULL").select("media_id", F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.struct(F.coalesce("end_ms", "start_ms").alias("end_ms"), (-F.col("paragraph_no")).alias("k"), "start_ms").alias("p"), F.lit(None).cast(dict(frames.dtypes)["frame_id"]).alias("frame_id"))
    shown = frames.select("media_id", F.col("timestamp_ms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(dict(timed.dtypes)["p"]).alias("p"), "frame_id")
    order = Window.partitionBy("media_id").orderBy("at", "kind", "frame_id")
    both = timed.unionByName(shown)
    before = F.max("p").over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("p", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    met = both.select("*", before.alias("before"), after.alias("after")).where("kind = 1")
    gap = lambda c: F.when(F.col("at").between(F.col(f"{c}.start_ms"), F.col(f"{c}.end_ms")), 0).otherwise(F.least(F.abs(F.col("at") - F.col(f"{c}.start_ms")), F.abs(F.col("at") - F.col(f"{c}.end_ms"))))
    choice = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), -F.col("before.k")).otherwise(-F.col("after.k"))
    near = met.select("media_id", "frame_id", "at", F.coalesce(choice, -F.col("after.k")).alias("paragraph_no"))
    turn = F.row_number().over(Window.partitionBy("media_id", "paragraph_no").orderBy("at", "frame_id"))
    return near.withColumn("turn", turn).select("media_id", "frame_id", F.when(F.col("turn") <= each, F.col("paragraph_no")).alias("paragraph_no"))


def assessment_issues(assessments: DataFrame, frames: DataFrame) -> DataFrame:
    """media_id, frame_id, code: assessments of frames that were not asked for, that repeat
    or that are missing, and values out of range."""
    said = assessments.groupBy("media_id", "frame_id").agg(F.count(F.lit(1)).alias("n"), F.max((~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).cast("int")).alias("bad"))
    asked = frames.select("media_id", "frame_id").distinct().withColumn("asked", F.lit(True))
    both = said.join(asked, ["media_id", "frame_id"], "full")
    codes = F.array(F.when(F.col("asked").isNull(), "unknown_frame"), F.when(F.col("n").isNull(), "missing_assessment"), F.when(F.col("n") > 1, "duplicate_assessment"), F.when(F.col("bad") == 1, "confidence_out_of_range"))
    return both.select("media_id", "frame_id", F.explode(F.array_compact(codes)).alias("code"))


def choose_tracks(tracks: DataFrame, preferred: str | None = None) -> DataFrame:
    """media_id, language, label: one caption track a medium: the preferred one, else
    simplified Chinese, else any Chinese, else the first (by ord)."""
    name = F.concat_ws(" ", "language", "label")
    rank = F.when((F.col("language") == F.lit(preferred)) | (F.col("label") == F.lit(preferred)), 0).when(name.rlike("(?i)zh-cn|简体|中文（简体）"), 1).when(name.rlike("(?i)zh|中文"), 2).otherwise(3)
    return tracks.groupBy("media_id").agg(F.min_by(F.struct("language", "label"), F.struct(rank, "ord")).alias("t")).select("media_id", "t.language", "t.label")


def chunk_coverage(chunks: DataFrame) -> DataFrame:
    """media_id, code: media with pending chunks, results whose hash differs, only empty
    chunks; some empty ones are a warning."""
    found = chunks.groupBy("media_id").agg(
        F.max(((F.col("status") == "pending") | F.col("result_hash").isNull()).cast("int")).alias("pending"), F.max((F.col("result_hash") != F.col("actual_hash")).cast("int")).alias("differs"),
        F.count_if(F.col("status") == "empty").alias("empty"), F.count(F.lit(1)).alias("n"),
    )
    code = F.when(F.col("pending") == 1, "COVERAGE_INCOMPLETE").when(F.col("differs") == 1, "RESULT_HASH_MISMATCH").when(F.col("empty") == F.col("n"), "EMPTY_TRANSCRIPT").when(F.col("empty") > 0, "EMPTY_CHUNKS")
    return found.select("media_id", code.alias("code")).where("code IS NOT NULL")


def trim_turns(messages: DataFrame, keep: int = 2) -> DataFrame:
    """conv_id, turn, role, text, kept: conversations cut to their last `keep` exchanges (a
    user's message behind an assistant's begins one); what comes before is told by kept."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    starts = (F.col("role") == "assistant") & (F.lead("role").over(order) == "user")
    marked = messages.withColumn("starts", starts)
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.sum(F.col("starts").cast("int")).over(last), F.lit(0))
    total = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("conv_id"))
    kept = (total <= keep) | (behind < keep - 1) | ((behind == keep - 1))
    return marked.select("conv_id", "turn", "role", "text", F.coalesce(kept, F.lit(True)).alias("kept"))


def trim_usage(trimmed: DataFrame) -> DataFrame:
    """conv_id, before_tokens, after_tokens: estimated tokens of all and of kept messages."""
    tokens = T.token_estimate(F.col("text"))
    return trimmed.groupBy("conv_id").agg(F.sum(tokens).alias("before_tokens"), F.sum(F.when(F.col("kept"), tokens).otherwise(0)).alias("after_tokens"))


def evidence_budgets(evidence: DataFrame, total: int = 110_000, least: int = 256, most: int = 8000) -> DataFrame:
    """run_id, ord, allowed, used: tokens that each piece of evidence (run_id, ord, tokens) may
    take: what is left, between `least` and `most`; what is left falls with what is used.

    Until the budget is nearly gone every piece may take `most`, so what is left is the budget
    less a running sum; from the first piece that finds less than `most` left, it is a fold
    over the rest of the run, which is short: each takes at least `least` or all it has.
    """
    order = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.least("tokens", F.lit(most))
    before = F.coalesce(F.sum(capped).over(order), F.lit(0))
    rows = evidence.select("run_id", "ord", "tokens", before.alias("before"))
    early = rows.where(F.lit(total) - F.col("before") >= most).select("run_id", "ord", F.lit(most).cast("long").alias("allowed"), F.least("tokens", F.lit(most)).cast("long").alias("used"))
    late = rows.where(F.lit(total) - F.col("before") < most).repartition("run_id").sortWithinPartitions("run_id", "ord")

    def run(batches):
        now, left = None, 0
        for b in batches:
            out = []
            for run_id, ord_, tokens, spent in zip(b.run_id, b.ord, b.tokens, b.before, strict=True):
                if run_id != now:
                    now, left = run_id, max(0, total - int(spent))
                allowed = max(least, min(most, left))
                used = min(int(tokens), allowed)
                left = max(0, left - used)
                out.append((run_id, ord_, allowed, used))
            yield pd.DataFrame(out, columns=["run_id", "ord", "allowed", "used"])

    kinds = dict(evidence.dtypes)
    return early.unionByName(late.mapInPandas(run, f"run_id {kinds['run_id']}, ord {kinds['ord']}, allowed long, used long"))
