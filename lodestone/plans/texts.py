"""Queries over names, transcripts and conversations, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.operators import timeline, transcripts
from lodestone.plans.register import query
from lodestone.sources.derived import segments_of, table

TOKENS = "CAST(length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) + ceil((length({0}) - length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g'))) / 4.0) AS BIGINT)"
SPACE = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


@query("representative_samples", "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE '[开头]' || chr(10) || substring(text, 1, 400) || chr(10) || chr(10) || '[中段]' || chr(10) || substring(text, CAST(greatest(400, floor(length(text) / 2.0 - 150)) AS INT) + 1, 300) || chr(10) || chr(10) || '[结尾]' || chr(10) || right(text, 300) END AS sample FROM documents")
def representative_samples(spark, d):
    return table(spark, d, "documents").select("doc_id", names.representative_sample(F.col("text"), 1000).alias("sample"))


@query("plain_paragraphs", rf"SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: regexp_replace(p, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10)), '') AS body FROM documents")
def plain_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", names.plain_paragraphs(F.col("text")).alias("body"))


#: Addresses made of keys, inside and outside the blocks that are not public.
ADDRESS = "CAST({0} % 256 AS {1}) || '.' || CAST({0} * 7 % 256 AS {1}) || '.' || CAST({0} * 13 % 256 AS {1}) || '.' || CAST({0} * 31 % 260 AS {1})"
_IN = " OR ".join(
    f"n BETWEEN {first} AND {first + (1 << (32 - int(p))) - 1}" for base, p in (b.split("/") for b in names.IPV4_BLOCKS) for first in [sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))]
)


@query("public_addresses", f"""SELECT o_orderkey, address, NOT (o_orderkey * 31 % 260 > 255) AND NOT ({_IN}) AS public FROM (SELECT o_orderkey, {ADDRESS.format('o_orderkey', 'VARCHAR')} AS address,
    o_orderkey % 256 * 16777216 + o_orderkey * 7 % 256 * 65536 + o_orderkey * 13 % 256 * 256 + o_orderkey * 31 % 260 AS n FROM orders)""")
def public_addresses(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(ADDRESS.format("o_orderkey", "STRING")).alias("address"))
    return rows.select("o_orderkey", "address", names.public_address(F.col("address")).alias("public"))


#: IPv6 addresses in several spellings, and whether they are public.
SIX = [("0:0:0:0:0:0:0:1", False), ("::1", False), ("::", False), ("0:0:0:0:0:ffff:a00:1", False), ("::ffff:8.8.8.8", False), ("2606:4700::{0}", True), ("FC00:0:0:0::{0}", False), ("fdff:{0}::", False), ("fe00::{0}", True), ("fe80::{0}%eth0", False),
       ("febf:{0}::1", False), ("fec0::{0}", True), ("ff02::{0}", False), ("2001:db8:{0}::", False), ("2001:0DB8::1:{0}", False), ("2001:db9::{0}", True), ("64:ff9b::1.2.3.{0}", None), (":::{0}", False), ("face:", False), ("1:2:3:4:5:6:7:8:{0}", False), ("1:2:3:4:5:6:7::", True), ("1::2::{0}", False), ("12345::{0}", False), ("", False)]


@query("public_addresses_v6", f"""SELECT o_orderkey, replace([{", ".join(repr(a) for a, _ in SIX)}][o_orderkey % {len(SIX)} + 1], '{{0}}', CAST(o_orderkey % 300 AS VARCHAR)) AS address,
    coalesce([{", ".join("NULL" if p is None else str(p).lower() for _, p in SIX)}][o_orderkey % {len(SIX)} + 1], o_orderkey % 300 < 256) AS public FROM orders""")
def public_addresses_v6(spark, d):
    k = F.col("o_orderkey")
    address = F.replace(F.element_at(F.array(*[F.lit(a) for a, _ in SIX]), (k % len(SIX) + 1).cast("int")), F.lit("{0}"), (k % 300).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", address.alias("address")).select("o_orderkey", "address", names.public_address(F.col("address")).alias("public"))


@query("published_names", r"""WITH b AS (SELECT doc_id, text, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(nfc_normalize(substring(text, 1, 70)), '\.[^.]+$', ''), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')), '[\x00-\x1F<>:"/\\|?*]', '-', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g')) AS n FROM documents)
    SELECT doc_id, CASE WHEN n = '' THEN 'document' ELSE substring(n, 1, 100) END || '--' || substring(sha256(text), 1, 8) || CASE WHEN doc_id % 3 = 0 THEN '--r' || CAST(doc_id % 3 + 2 AS VARCHAR) ELSE '' END || '.md' AS name FROM b""")
def published_names(spark, d):
    revision = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)
    return table(spark, d, "documents").select("doc_id", names.published_name(names.canonical_basename(F.substring("text", 1, 70)), F.sha2("text", 256), revision).alias("name"))


@query("untimed_paragraphs")
def untimed_paragraphs(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.lit(0).alias("ord"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), "text")
    return transcripts.normalize_segments(rows).select("media_id", "part", "text")


@query("word_groups")
def word_groups(spark, d):
    """Words of conversations, 300 ms each, with a pause of two seconds behind every ninth."""
    words = F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("k", "text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), words)
    start = F.col("turn") * 1_000_000 + F.col("k") * 300 + F.floor(F.col("k") / 9) * 2000
    rows = rows.select(F.col("conv_id").alias("media_id"), (F.col("turn") * 100_000 + F.col("k")).alias("ord"), start.alias("start_ms"), (start + 250).alias("end_ms"), "speaker", "text")
    return transcripts.word_groups(rows)


@query("transcript_adapter", """SELECT conv_id AS media_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS ord, turn * 4000 AS start_ms, turn * 4000 + 1500 AS end_ms, trim(text) AS text, role AS speaker FROM conversations""")
def transcript_adapter(spark, d):
    """Conversations as service responses: seconds or milliseconds, nested or not."""
    c, k = table(spark, d, "conversations"), F.col("conv_id")
    seconds = F.struct(F.col("text"), (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 1.5).alias("end"), F.col("role").alias("speaker"))
    exact = F.struct(F.col("text"), (F.col("turn") * 4000).alias("start_ms"), (F.col("turn") * 4000 + 1500).alias("end_ms"), F.col("role").alias("speaker_id"))
    one = F.when(k % 2 == 0, F.to_json(seconds)).otherwise(F.to_json(exact))
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", one.alias("j")))), lambda x: x["j"]), ",").alias("items"))
    flat = F.concat(F.when(k % 2 == 0, '{"segments":[').otherwise('{"utterances":['), "items", F.lit("]}"))
    body = F.when(k % 3 == 0, F.concat(F.lit('{"data":{"result":'), flat, F.lit("}}"))).otherwise(flat)
    return transcripts.adapt_responses(rows.select(k.alias("media_id"), body.alias("body"))).select("media_id", "ord", "start_ms", "end_ms", "text", "speaker")


@query("transcript_warnings", """WITH s AS (SELECT conv_id AS media_id, count(*) AS n, count(DISTINCT text) AS k, sum(length(text)) AS c FROM conversations GROUP BY 1)
    SELECT media_id, 'TRANSCRIPT_SHORT' AS code FROM s WHERE c < 160 UNION ALL SELECT media_id, 'TRANSCRIPT_REPETITION_HIGH' FROM s WHERE n >= 10 AND k / n < 0.7""")
def transcript_warnings(spark, d):
    return transcripts.transcript_warnings(segments_of(table(spark, d, "conversations")).withColumn("confidence", F.lit(None).cast("double")))


def _frames(spark, d):
    """Three frames a conversation, between and behind its turns."""
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("media_id")).agg(F.max("turn").alias("last"))
    at = F.explode(F.array(F.lit(1000), F.col("last") * 3000 + 777, F.col("last") * 9000)).alias("timestamp_ms")
    return c.select("media_id", at).select("media_id", F.col("timestamp_ms").cast("long").alias("timestamp_ms")).distinct().withColumn("frame_id", F.concat(F.lit("f"), F.lpad(F.col("timestamp_ms").cast("string"), 10, "0")))


SEGMENTS = "s AS (SELECT conv_id AS media_id, turn AS ord, turn * 4000 + (turn + 1) // 3 * 4000 AS a, turn * 4000 + (turn + 1) // 3 * 4000 + 1500 AS b, trim(coalesce(text, '')) AS text FROM conversations)"
FRAMES = "f AS (SELECT DISTINCT media_id, t, 'f' || lpad(CAST(t AS VARCHAR), 10, '0') AS frame_id FROM (SELECT conv_id AS media_id, unnest([1000, max(turn) * 3000 + 777, max(turn) * 9000]) AS t FROM conversations GROUP BY 1))"


@query("frame_texts", f"WITH {SEGMENTS}, {FRAMES} SELECT f.media_id, f.frame_id, coalesce(substring(string_agg(text, ' ' ORDER BY ord, text), 1, 6000), '') AS text FROM f LEFT JOIN s ON s.media_id = f.media_id AND s.text <> '' AND b >= t - 30000 AND a <= t + 30000 GROUP BY 1, 2")
def frame_texts(spark, d):
    return transcripts.frame_texts(_frames(spark, d), segments_of(table(spark, d, "conversations")))


@query("aligned_frames", f"""WITH {SEGMENTS}, {FRAMES}, p AS (SELECT f.media_id, f.frame_id, t, ord, row_number() OVER (PARTITION BY f.media_id, f.frame_id ORDER BY CASE WHEN t BETWEEN a AND b THEN 0 ELSE least(abs(t - a), abs(t - b)) END, ord) AS n FROM f JOIN s USING (media_id))
    SELECT media_id, frame_id, CASE WHEN row_number() OVER (PARTITION BY media_id, ord ORDER BY t, frame_id) <= 2 THEN ord END AS paragraph_no FROM p WHERE n = 1""")
def aligned_frames(spark, d):
    rows = segments_of(table(spark, d, "conversations")).select("media_id", F.col("ord").alias("paragraph_no"), "start_ms", "end_ms")
    return transcripts.align_frames(_frames(spark, d), rows)


@query("trimmed_turns", f"""WITH m AS (SELECT *, role = 'assistant' AND lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' AS starts FROM conversations), t AS (SELECT conv_id, turn FROM m WHERE starts QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 2),
    n AS (SELECT conv_id, count(*) AS k FROM m WHERE starts GROUP BY 1), r AS (SELECT m.conv_id, {TOKENS.format("coalesce(text, '')")} AS tokens, coalesce(k, 0) <= 2 OR m.turn >= t.turn AS kept FROM m LEFT JOIN n USING (conv_id) LEFT JOIN t ON t.conv_id = m.conv_id)
    SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS before_tokens, CAST(sum(CASE WHEN kept THEN tokens ELSE 0 END) AS BIGINT) AS after_tokens FROM r GROUP BY 1""")
def trimmed_turns(spark, d):
    return transcripts.trim_usage(transcripts.trim_turns(table(spark, d, "conversations")))


@query("evidence_budgets")
def evidence_budgets(spark, d):
    """Documents of a source as the evidence of a run, in the order of their ids."""
    rows = table(spark, d, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").alias("ord"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    return transcripts.evidence_budgets(rows)


@query("timeline_issues", f"""WITH {SEGMENTS}, o AS (SELECT media_id, ord, CASE WHEN ord % 10 = 4 THEN a - 20000 ELSE a END AS a, CASE WHEN ord % 10 = 7 THEN a - 1 ELSE b END AS b, text FROM s), w AS (SELECT *, max(a) OVER (PARTITION BY media_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o)
    SELECT media_id, ord, 'not_monotonic' AS code FROM w WHERE a < top UNION ALL SELECT media_id, ord, 'ends_before_start' FROM w WHERE b < a UNION ALL SELECT media_id, ord, 'out_of_range' FROM w WHERE a > 41000 OR b > 41000
    UNION ALL SELECT media_id, ord, 'replacement_character' FROM w WHERE contains(text, chr(65533))""")
def timeline_issues(spark, d):
    """Segments with some starts moved back, some ends before them, and a limit of 40 s."""
    s = segments_of(table(spark, d, "conversations"))
    late = F.when(F.col("ord") % 10 == 7, F.col("start_ms") - 1).otherwise(F.col("end_ms"))
    s = s.withColumn("end_ms", late).withColumn("start_ms", F.when(F.col("ord") % 10 == 4, F.col("start_ms") - 20_000).otherwise(F.col("start_ms"))).withColumn("duration_ms", F.lit(40_000))
    return timeline.timeline_issues(s)
