"""Queries over nested rows, captions, jobs, inboxes, candidates and raw artifacts, with their SQL.

Flaws are made by changing rows of the given tables, never by leaving rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import decoding, json_text
from lodestone.operators import artifacts, candidates, pages, schema_check
from lodestone.plans.register import query
from lodestone.sources import captions, inbox, intake, manifests
from lodestone.sources.derived import table
from lodestone.storage import stored
from lodestone.streaming import checkpoints

ORDER_SCHEMA = {
    "type": "object", "required": ["id", "status", "lines"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "status": {"enum": ["O", "F", "P"]}, "kind": {"const": "order"}, "total": {"type": "number", "maximum": 400000},
        "lines": {"type": "array", "minItems": 1, "maxItems": 6, "items": {"type": "object", "required": ["part", "quantity"], "properties": {
            "part": {"type": "integer"}, "quantity": {"type": "number", "minimum": 2}, "flag": {"type": "string", "minLength": 1, "maxLength": 1, "pattern": "^[ANR]$"}, "late": {"type": "boolean"}}}},
    },
}


@query("nested_violations", """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, * FROM lineitem),
    o AS (SELECT o_orderkey AS id, o_orderkey % 19 = 0 AS nameless, o_totalprice, n FROM orders LEFT JOIN (SELECT DISTINCT k, n FROM l) ON k = o_orderkey)
    SELECT id, 'input' AS path, 'invalid_json' AS code FROM o WHERE id % 29 = 0
    UNION ALL SELECT id, 'input', 'not_object' FROM o WHERE id % 29 <> 0 AND id % 31 = 0
    UNION ALL SELECT id, path, code FROM (
        SELECT id, 'input.status' AS path, CASE WHEN nameless THEN 'missing' ELSE 'enum' END AS code FROM o WHERE nameless OR id % 5 = 0
        UNION ALL SELECT id, 'input.id', 'not_integer' FROM o WHERE id % 7 = 0
        UNION ALL SELECT id, 'input.note', 'unexpected' FROM o WHERE id % 11 = 0
        UNION ALL SELECT id, 'input.kind', 'const' FROM o WHERE id % 13 = 0
        UNION ALL SELECT id, 'input.total', 'above_maximum' FROM o WHERE o_totalprice > 400000
        UNION ALL SELECT id, 'input.lines', CASE WHEN n IS NULL THEN 'too_few' ELSE 'too_many' END FROM o WHERE n IS NULL OR n > 6
        UNION ALL SELECT k, 'input.lines[' || i || ']' || x.path, x.code FROM (SELECT k, i, l_quantity, l_returnflag, l_partkey, unnest([
            CASE WHEN l_partkey % 9 = 0 THEN {'path': '.part', 'code': 'missing'} END, CASE WHEN l_quantity < 2 THEN {'path': '.quantity', 'code': 'below_minimum'} END,
            CASE WHEN l_partkey % 10 = 3 THEN {'path': '.flag', 'code': 'pattern'} END, CASE WHEN l_partkey % 10 = 4 THEN {'path': '.flag', 'code': 'too_long'} END, CASE WHEN l_partkey % 10 = 4 THEN {'path': '.flag', 'code': 'pattern'} END,
            CASE WHEN l_partkey % 10 = 5 THEN {'path': '.late', 'code': 'not_boolean'} END]) AS x FROM l) WHERE x IS NOT NULL
    ) WHERE id % 29 <> 0 AND id % 31 <> 0""")
def nested_violations(spark, d):
    """Orders with their lines as JSON; keys tell which flaw a row gets."""
    key, part = F.col("o_orderkey"), F.col("l_partkey")
    flag = F.when(part % 10 == 3, F.lower("l_returnflag")).when(part % 10 == 4, F.concat("l_returnflag", F.lit("xx"))).otherwise(F.col("l_returnflag"))
    line = F.concat(
        F.lit("{"), F.when(part % 9 == 0, "").otherwise(F.concat(F.lit('"part":'), part.cast("string"), F.lit(","))), F.lit('"quantity":'), F.col("l_quantity").cast("string"),
        F.lit(',"flag":"'), flag, F.lit('","late":'), F.when(part % 10 == 5, "1").otherwise("true"), F.lit("}"),
    )
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", line.alias("line")))), lambda x: x["line"]), ",").alias("lines"))
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    text = F.concat(
        F.lit('{"id":'), F.when(key % 7 == 0, F.concat(F.lit('"'), key.cast("string"), F.lit('"'))).otherwise(key.cast("string")),
        F.when(key % 19 == 0, "").otherwise(F.concat(F.lit(',"status":'), F.when(key % 5 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))))),
        F.when(key % 11 == 0, ',"note":{}').otherwise(""), F.when(key % 13 == 0, ',"kind":["order"]').otherwise(',"kind":"order"'),
        F.lit(',"total":'), F.format_string("%.2f", "o_totalprice"), F.lit(',"lines":['), F.coalesce("lines", F.lit("")), F.lit("]}"),
    )
    json = F.when(key % 29 == 0, F.substring(text, 1, 20)).when(key % 31 == 0, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return schema_check.violations(rows.select(key.alias("id"), json.alias("json")), ORDER_SCHEMA)


@query("json_objects", """WITH o AS (SELECT o_orderkey AS k, '{"k": ' || o_orderkey || ', "t": "a }{ \\" ' || o_orderpriority || '", "n": {"x": []}}' AS j FROM orders)
    SELECT k, CASE WHEN k % 6 IN (4, 5) THEN NULL ELSE CAST(k AS VARCHAR) END AS found, CASE k % 6 WHEN 0 THEN 'fenced' WHEN 1 THEN 'braces' WHEN 2 THEN 'balanced' WHEN 3 THEN 'balanced' END AS source, CASE WHEN k % 6 IN (4, 5) THEN NULL WHEN k % 6 = 0 THEN sha256(j || chr(10)) ELSE sha256(j) END AS hash FROM o""")
def json_objects(spark, d):
    """Orders as objects in texts: fenced, with words around, with braces behind, behind a
    fence of something else, cut off, or none."""
    k = F.col("o_orderkey")
    j = F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "t": "a }{ \\" '), "o_orderpriority", F.lit('", "n": {"x": []}}'))
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Here:\n```JSON\n"), j, F.lit("\n```\n{}"))).when(k % 6 == 1, F.concat(F.lit("It is "), j, F.lit(" so."))).when(k % 6 == 2, F.concat(F.lit("First "), j, F.lit(" then {that}.")))
        .when(k % 6 == 3, F.concat(F.lit("```\ncode\n``` "), j)).when(k % 6 == 4, F.concat(F.lit("cut "), F.substring(j, 1, 12))).otherwise("nothing")
    )
    rows = table(spark, d, "orders").select(k.alias("k"), json_text.json_object(text).alias("j"))
    return rows.select("k", F.try_variant_get(F.try_parse_json("j.json"), "$.k", "long").cast("string").alias("found"), "j.source", F.sha2("j.json", 256).alias("hash"))


def _caption_files(spark, d) -> DataFrame:
    """Conversations as caption packages, a segment a turn; blank ones, times that are no
    numbers, and files that are no package come by the ids."""
    turn = F.col("turn")
    segment = F.struct(
        F.when(turn % 4 == 3, F.concat(F.lit("t"), turn.cast("string"))).alias("skip"), (turn * 3000 + F.when(turn % 5 == 4, 2500).otherwise(0)).alias("startMs"), (turn * 3000 + 2000).alias("endMs"),
        F.when(turn % 7 == 6, "  ").otherwise(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n"))).alias("text"), "role",
    )
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", segment.alias("s")))).alias("s"))
    items = F.transform("s", lambda x: F.struct(F.when(x["s"]["skip"].isNull(), x["s"]["startMs"]).alias("startMs"), x["s"]["endMs"].alias("endMs"), x["s"]["text"].alias("text"), x["s"]["role"].alias("speaker")))
    text = F.to_json(F.struct(F.when(F.col("conv_id") % 9 == 8, 2).otherwise(1).alias("schemaVersion"), F.concat(F.lit("BV"), F.col("conv_id").cast("string")).alias("bvid"), (F.col("conv_id") % 3).alias("page"),
                              F.when(F.col("conv_id") % 2 == 0, "ai").otherwise("robot").alias("trackKind"), items.alias("segments")))
    return rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.when(F.col("conv_id") % 10 == 7, F.substring(text, 1, 30)).otherwise(text).alias("content"))


BLANK = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
CAPTIONS = f"""c AS (SELECT *, regexp_replace(coalesce(text, ''), '^[{BLANK}]+|[{BLANK}]+$', '', 'g') AS t FROM conversations),
    seg AS (SELECT 'c' || conv_id AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n, CASE WHEN turn % 4 <> 3 THEN CAST(turn * 3000 + CASE WHEN turn % 5 = 4 THEN 2500 ELSE 0 END AS DOUBLE) END AS start_ms,
        CAST(turn * 3000 + 2000 AS DOUBLE) AS end_ms, t AS text, role AS speaker FROM c WHERE turn % 7 <> 6 AND t <> '' AND conv_id % 9 <> 8 AND conv_id % 10 <> 7)"""


@query("caption_segments", f"WITH {CAPTIONS} SELECT * FROM seg")
def caption_segments(spark, d):
    return captions.segments(captions.packages(_caption_files(spark, d)))


@query("caption_issues", f"""WITH {CAPTIONS} SELECT 'c' || conv_id AS path, CASE WHEN conv_id % 10 = 7 THEN 'INVALID_JSON' WHEN conv_id % 9 = 8 THEN 'INVALID_PACKAGE' ELSE 'NO_SEGMENTS' END AS code
    FROM (SELECT DISTINCT conv_id FROM conversations) WHERE 'c' || conv_id NOT IN (SELECT path FROM seg)""")
def caption_issues(spark, d):
    return captions.issues(captions.packages(_caption_files(spark, d)))


@query("caption_paragraphs", f"""WITH RECURSIVE {CAPTIONS}, p AS (
        SELECT path, n, 1 AS paragraph, length(text) AS held, start_ms, end_ms, text FROM seg WHERE n = 1
        UNION ALL SELECT s.path, s.n, s.paragraph + CAST(s.cut AS INTEGER), CASE WHEN s.cut THEN 0 ELSE s.held END + length(s.text), s.start_ms, s.end_ms, s.text
        FROM (SELECT seg.*, p.paragraph, p.held, coalesce(seg.start_ms - p.end_ms > 2000, false) OR p.held > 400 AS cut FROM seg JOIN p ON seg.path = p.path AND seg.n = p.n + 1) s)
    SELECT path, CAST(paragraph AS INTEGER) AS paragraph, first(start_ms ORDER BY n) AS start_ms, last(end_ms ORDER BY n) AS end_ms, string_agg(text, ' ' ORDER BY n) AS text FROM p GROUP BY path, paragraph""")
def caption_paragraphs(spark, d):
    """The table function over a partitioned table argument, in SQL."""
    captions.register(spark)
    caption_segments(spark, d).createOrReplaceTempView("caption_segments_in")
    return spark.sql("SELECT * FROM caption_paragraphs(TABLE(SELECT path, n, start_ms, end_ms, text FROM caption_segments_in) PARTITION BY path ORDER BY n)")


@query("job_checkpoints", """WITH c AS (SELECT 'u' || user_id AS job_id, ts, CASE WHEN event_id % 400 < 200 THEN 'x' ELSE 'y' END AS source_hash, CAST(event_id % 50 AS INTEGER) AS chunk FROM events),
    b AS (SELECT *, lag(ts) OVER w AS before, lag(source_hash) OVER w AS was FROM c WINDOW w AS (PARTITION BY job_id ORDER BY ts, chunk, source_hash)),
    k AS (SELECT *, CASE WHEN before IS NULL THEN 'first' WHEN was <> source_hash THEN 'replaced' WHEN ts >= before + INTERVAL 3 HOURS THEN 'expired' END AS came FROM b),
    l AS (SELECT *, count(came) OVER (PARTITION BY job_id ORDER BY ts, chunk, source_hash) AS life FROM k),
    g AS (SELECT job_id, CAST(life AS INTEGER) AS life, min(source_hash) AS source_hash, CAST(count(DISTINCT chunk) AS INTEGER) AS chunks, min(ts) AS started, max(ts) + INTERVAL 3 HOURS AS expires_at, max(came) AS came FROM l GROUP BY job_id, life)
    SELECT job_id, life, source_hash, chunks, started, expires_at, coalesce(lead(came) OVER (PARTITION BY job_id ORDER BY life), 'expired') AS ending FROM g""")
def job_checkpoints(spark, d):
    key = F.col("event_id")
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), "ts", F.when(key % 400 < 200, "x").otherwise("y").alias("source_hash"), (key % 50).alias("chunk"))
    return checkpoints.replayed(rows, hours=3)


def _inbox(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents as files of an inbox: every ninth is no Markdown, every eleventh UTF-16, every
    thirteenth holds a stray byte; what every fourth document says is known already."""
    docs, key = table(spark, d, "documents"), F.col("doc_id")
    name = F.concat(F.lit("in/"), F.lpad(key.cast("string"), 8, "0"), F.when(key % 9 == 8, ".txt").otherwise(".MD"))
    plain = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    content = F.when(key % 13 == 12, F.concat(plain, F.unhex(F.lit("FF")))).when(key % 11 == 10, F.concat(F.unhex(F.lit("FFFE")), F.encode(F.coalesce("text", F.lit("")), "UTF-16LE"))).otherwise(plain)
    files = docs.select(name.alias("path"), content.alias("content")).select("path", F.length("content").cast("long").alias("length"), "content")
    return files, docs.where(key % 4 == 0).select(F.sha2("text", 256).alias("hash"), F.concat(F.lit("s"), key.cast("string")).alias("source_id"))


INBOX = """f AS (SELECT doc_id, 'in/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.MD' AS path, coalesce(text, '') AS text, doc_id % 13 = 12 AS bad, doc_id % 11 = 10 AS wide FROM documents WHERE doc_id % 9 <> 8),
    known AS (SELECT text, min('s' || doc_id) AS id FROM documents WHERE doc_id % 4 = 0 GROUP BY 1),
    j AS (SELECT f.*, k.id, min(CASE WHEN NOT bad THEN path END) OVER (PARTITION BY f.text, wide) AS first FROM f LEFT JOIN known k ON k.text = f.text AND NOT wide),
    s AS (SELECT path, text, wide, CASE WHEN bad THEN 'failed' WHEN id IS NOT NULL OR first <> path THEN 'duplicate' ELSE 'imported' END AS status, CASE WHEN bad THEN 'UNSUPPORTED_ENCODING' END AS reason,
        CASE WHEN NOT bad THEN coalesce(id, CASE WHEN first <> path THEN first END) END AS original FROM j)"""


@query("inbox_scan", f"WITH {INBOX} SELECT path, status, reason, original FROM s")
def inbox_scan(spark, d):
    return inbox.judged(*_inbox(spark, d)).select("path", "status", "reason", "original")


@query("inbox_counts", f"WITH {INBOX} SELECT count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'failed') AS failed, CAST(sum(CASE WHEN status = 'imported' THEN strlen(text) ELSE 0 END) AS BIGINT) AS bytes FROM s")
def inbox_counts(spark, d):
    """One row: what the write counted on its way."""
    counts, _ = inbox.write_counted(inbox.judged(*_inbox(spark, d)), stored)
    return spark.createDataFrame([tuple(counts[c] for c in ("imported", "duplicates", "failed", "bytes"))], "imported long, duplicates long, failed long, bytes long")


@query("decoded_pages", """WITH p AS (SELECT page_id, html, page_id % 8 AS k FROM pages)
    SELECT page_id, CASE k WHEN 1 THEN 'utf-16-le' WHEN 2 THEN 'iso-8859-1' WHEN 3 THEN 'windows-1251' WHEN 4 THEN 'x-none' WHEN 6 THEN 'utf-16-be' ELSE 'utf-8' END AS charset,
        CASE WHEN k IN (4, 5) THEN 'UNSUPPORTED_ENCODING' END AS error,
        CASE WHEN k IN (4, 5) THEN NULL WHEN k IN (2, 3) THEN sha256(CASE WHEN k = 3 THEN '<meta charset="windows-1251">' ELSE '' END || regexp_replace(html, '[^\\x00-\\x7F]', '?', 'g')) ELSE sha256(html) END AS text_hash FROM p""")
def decoded_pages(spark, d):
    """Web pages as bytes in several charsets, told by a mark, the header, a tag or nothing;
    some in a charset that nobody knows or with a stray byte."""
    k, html = F.col("page_id") % 8, F.col("html")
    plain = F.encode(F.regexp_replace(html, r"[^\x00-\x7F]", "?"), "US-ASCII")
    utf8 = F.encode(html, "UTF-8")
    content = (
        F.when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE"))).when(k == 2, plain).when(k == 3, F.concat(F.encode(F.lit('<meta charset="windows-1251">'), "UTF-8"), plain))
        .when(k == 5, F.concat(utf8, F.unhex(F.lit("C3")))).when(k == 6, F.concat(F.unhex(F.lit("FEFF")), F.encode(html, "UTF-16BE"))).when(k == 7, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(utf8)
    )
    header = F.when(k == 2, "text/html; Charset='ISO-8859-1'").when(k == 4, "text/html;charset=x-none").when(k.isin(1, 6, 7), "text/html; charset=latin1").when(k == 3, "text/html").otherwise("text/html; charset=UTF-8")
    rows = table(spark, d, "pages").select("page_id", decoding.decode_html(content, header).alias("d"))
    return rows.select("page_id", "d.charset", "d.error", F.sha2("d.text", 256).alias("text_hash"))


def _requests(spark, d) -> DataFrame:
    """Line items ask for ids in their order's month: of their part's brand, some of them with
    a number behind it, some blank."""
    line, k = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), F.col("l_partkey")
    base = F.concat(F.lit("p"), (k % 7).cast("string"))
    wanted = F.when(k % 11 == 0, " ").when(k % 5 == 0, F.concat(base, F.lit("-"), (k % 4 + 2).cast("string"))).when(k % 13 == 0, F.concat(base, F.lit("-2-"), (k % 3 + 2).cast("string"))).otherwise(base)
    return line.select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), wanted.alias("wanted"), F.when(k % 2 == 0, "entity").otherwise("concept").alias("type"))


@query("unique_ids")
def unique_ids(spark, d):
    return candidates.unique_ids(_requests(spark, d))



def _drafts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as drafts in texts of a batch each; by the key, one is left out, left open,
    written twice or nobody's."""
    k = F.col("o_orderkey")
    batch = F.concat(F.lit("b"), (k % 100).cast("string"))
    id_ = F.when(k % 17 == 3, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("o"), k.cast("string")))
    head = F.concat(
        F.lit("---\nschema_version: 1\ntype: "), F.when(k % 6 == 1, "concept").otherwise("synthesis"), F.lit("\ntitle: Order "), k.cast("string"), F.when(k % 5 == 1, "\ntldr: \"\"").otherwise("\ntldr: short"),
        F.lit("\nstatus: draft\ncreated: 2024-01-01\nupdated: 2024-01-02\ntags: "), F.when(k % 7 == 2, "one").otherwise("[one]"), F.when(k % 8 == 5, "").otherwise("\nrelated: []"), F.lit("\nsources: []\nconflicts: []\n---\n# Order\n"),
        F.when(k % 9 == 4, "").otherwise("Text.\n"),
    )
    content = F.when(k % 10 == 9, "no block").otherwise(head)
    one = F.concat(F.lit("<!-- llm-wiki:draft="), id_, F.lit(" -->\n"), content, F.when(k % 19 == 5, "").otherwise("\n<!-- llm-wiki:end-draft -->\n"))
    text = F.when(k % 13 == 2, "").when(k % 23 == 7, F.concat(one, one)).otherwise(one)
    # Texts are many times their keys, so keys are dealt before: files of few bytes would give few tasks.
    rows = table(spark, d, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    texts = rows.select(F.concat(batch, F.lit("-"), k.cast("string")).alias("batch_id"), text.alias("text"))
    return texts, rows.select(F.concat(batch, F.lit("-"), k.cast("string")).alias("batch_id"), F.concat(F.lit("o"), k.cast("string")).alias("candidate_id"))


DRAFT_STATUS = """WITH e AS (SELECT o_orderkey AS k, 'b' || (o_orderkey % 100) || '-' || o_orderkey AS batch_id FROM orders),
    f AS (SELECT *, CASE WHEN k % 13 = 2 OR (k % 19 = 5) THEN 0 WHEN k % 23 = 7 THEN 2 ELSE 1 END AS n, k % 17 = 3 AS other FROM e),
    st AS (SELECT batch_id, 'o' || k AS candidate_id, CASE WHEN other OR n = 0 THEN 'missing' WHEN n = 2 THEN 'repeated' ELSE 'ok' END AS status, k FROM f
    UNION ALL SELECT batch_id, 'x' || k, 'unexpected', k FROM f WHERE other AND n > 0)"""


@query("draft_status", f"{DRAFT_STATUS} SELECT batch_id, candidate_id, status FROM st")
def draft_status(spark, d):
    texts, expected = _drafts(spark, d)
    return candidates.draft_status(candidates.marked_drafts(texts), expected).select("batch_id", "candidate_id", "status")


@query("draft_issues", f"""{DRAFT_STATUS}, ok AS (SELECT * FROM st WHERE status = 'ok')
    SELECT batch_id, candidate_id, 'invalid_page' AS code, NULL AS detail FROM ok WHERE k % 10 = 9
    UNION ALL SELECT batch_id, candidate_id, x.code, x.detail FROM (SELECT *, unnest([CASE WHEN k % 6 = 1 THEN {{'code': 'wrong_type', 'detail': NULL}} END, CASE WHEN k % 5 = 1 THEN {{'code': 'missing_field', 'detail': 'tldr'}} END,
        CASE WHEN k % 7 = 2 THEN {{'code': 'not_a_list', 'detail': 'tags'}} END, CASE WHEN k % 8 = 5 THEN {{'code': 'missing_field', 'detail': 'related'}} END, CASE WHEN k % 8 = 5 THEN {{'code': 'not_a_list', 'detail': 'related'}} END,
        CASE WHEN k % 9 = 4 THEN {{'code': 'empty_body', 'detail': NULL}} END]) AS x FROM ok WHERE k % 10 <> 9) WHERE x IS NOT NULL""")
def draft_issues(spark, d):
    texts, expected = _drafts(spark, d)
    good = candidates.draft_status(candidates.marked_drafts(texts), expected).where("status = 'ok'")
    read = pages.with_front_matter(good, "m").select("batch_id", "candidate_id", F.lit("synthesis").alias("type"), "content", "m.fields", "m.body")
    return candidates.draft_issues(read)


def _assets(spark, d) -> DataFrame:
    """Parts as assets of their lines' orders; types, ids and repeats by the keys."""
    k, line = F.col("l_partkey"), F.col("l_linenumber")
    id_ = F.when(k % 37 == 0, F.concat(F.lit("a "), line.cast("string"))).when(k % 41 == 0, "a1").otherwise(F.concat(F.lit("a"), line.cast("string")))
    mime = F.element_at(F.array(*map(F.lit, ["image/png", "IMAGE/JPEG", "image/webp", "image/gif", "image/svg+xml", "image/tiff"])), (k % 6 + 1).cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), id_.alias("asset_id"), mime.alias("mime"), F.encode(F.repeat(F.lit("x"), F.col("l_quantity").cast("int")), "UTF-8").alias("content"))


ASSETS = """a AS (SELECT l_orderkey AS source_id, CASE WHEN l_partkey % 37 = 0 THEN 'a ' || l_linenumber WHEN l_partkey % 41 = 0 THEN 'a1' ELSE 'a' || l_linenumber END AS asset_id,
        ['image/png', 'IMAGE/JPEG', 'image/webp', 'image/gif', 'image/svg+xml', 'image/tiff'][l_partkey % 6 + 1] AS mime, ['png', 'jpg', 'webp', 'gif', 'svg', NULL][l_partkey % 6 + 1] AS ext, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
    t AS (SELECT source_id, asset_id, mime, size, sha256(repeat('x', CAST(size AS INTEGER))) AS hash, ext, CASE WHEN contains(asset_id, ' ') THEN 'INVALID_ASSET_ID' WHEN count(*) OVER (PARTITION BY source_id, asset_id) > 1 THEN 'DUPLICATE_ASSET_ID' WHEN ext IS NULL THEN 'UNSUPPORTED_MIME' END AS error FROM a),
    p AS (SELECT * EXCLUDE (ext), CASE WHEN error IS NULL THEN 'raw/assets/' || source_id || '/' || asset_id || '.' || ext END AS path FROM t)"""


@query("asset_table", f"WITH {ASSETS} SELECT * FROM p")
def asset_table(spark, d):
    return artifacts.asset_table(_assets(spark, d))


@query("asset_totals", f"WITH {ASSETS} SELECT source_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN max(size) > 45 OR min(size) = 0 THEN 'ASSET_INVALID' WHEN sum(size) > 150 THEN 'ASSET_LIMIT' END AS error FROM p GROUP BY 1")
def asset_totals(spark, d):
    return artifacts.asset_totals(artifacts.asset_table(_assets(spark, d)), most_bytes=150, most_each=45)


def _with_placeholders(spark, d) -> DataFrame:
    """Orders whose text shows their lines' assets, last line first, and some the first again."""
    shown = F.transform(F.reverse(F.sequence(F.lit(1), F.col("n").cast("int"))), lambda i: F.concat(F.lit("![x](llm-wiki-asset:a"), i.cast("string"), F.lit(")")))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.max("l_linenumber").alias("n"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id")).join(lines, "source_id", "left")
    again = F.when(F.col("source_id") % 3 == 0, " llm-wiki-asset:a1.").otherwise("")
    return rows.select("source_id", F.when(F.col("n").isNull(), "plain").otherwise(F.concat(F.array_join(shown, " "), again)).alias("markdown"))


PLACED = f"""{ASSETS}, o AS (SELECT o_orderkey AS source_id, n FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
    want AS (SELECT source_id, n, unnest(generate_series(1, CAST(n AS BIGINT))) AS i FROM o WHERE n IS NOT NULL),
    got AS (SELECT w.source_id, w.i, '../' || substring(p.path, 5) AS to_ FROM want w LEFT JOIN p ON p.source_id = w.source_id AND p.asset_id = 'a' || w.i AND p.path IS NOT NULL),
    done AS (SELECT source_id, CASE WHEN count(*) = count(to_) THEN string_agg('![x](' || to_ || ')', ' ' ORDER BY i DESC) || CASE WHEN source_id % 3 = 0 THEN ' ' || max(CASE WHEN i = 1 THEN to_ END) || '.' ELSE '' END END AS markdown FROM got GROUP BY 1)"""


@query("placed_assets", f"WITH {PLACED} SELECT source_id, markdown FROM done UNION ALL SELECT source_id, 'plain' FROM o WHERE n IS NULL")
def placed_assets(spark, d):
    return artifacts.place_assets(_with_placeholders(spark, d), artifacts.asset_table(_assets(spark, d)))[0]


@query("unknown_assets", f"WITH {PLACED} SELECT source_id, 'a' || i AS asset_id FROM got WHERE to_ IS NULL")
def unknown_assets(spark, d):
    return artifacts.place_assets(_with_placeholders(spark, d), artifacts.asset_table(_assets(spark, d)))[1]


#: What is wrong with a document's raw file, by doc_id modulo 41; the rest is in order.
RAW_FLAWS = ["PATH_OUTSIDE", "FILE_MISSING", "ARTIFACT_HASH", "FRONT_MATTER", "KIND", "SOURCE_ID", "SOURCE_HASH", "PARSER_ID", "PARSER_VERSION", "BODY_HASH", "CONTENT_HASH", "SCHEMA_VERSION", "SOURCE_KIND",
             "PAGE_MARKS", "MAP_UNNAMED", "MAP_UNREADABLE", "MAP_SOURCE", "MAP_REPEATED", "MAP_BLOCKS", "MAP_LINES", "MAP_PLACE", "MARKS_LEFT", "MAP_UNEXPECTED", "ASSET_OUTSIDE", "ASSET_MISSING", "ASSET_HASH"]
_OF_TWO = ["MAP_UNNAMED", "MAP_UNREADABLE", "MAP_SOURCE", "MAP_REPEATED", "MAP_BLOCKS", "MAP_LINES", "MAP_PLACE"]
_OF_THREE = ["MARKS_LEFT", "MAP_UNEXPECTED"]


def raw_corpus(spark, d) -> dict[str, DataFrame]:
    """Revisions, files, maps, assets and objects made of the documents, with RAW_FLAWS."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ").alias("flat"))
    docs = docs.withColumn("flaw", F.coalesce(F.try_element_at(F.array(*map(F.lit, RAW_FLAWS)), (k % 41 + 1).cast("int")), F.lit("")))
    is_ = lambda *names: F.col("flaw").isin(*names)
    version = F.when(is_(*_OF_TWO), 2).when(is_(*_OF_THREE), 3).when(is_("SCHEMA_VERSION", "SOURCE_KIND"), 2 + k % 2).when(is_("PAGE_MARKS"), 1 + k % 2).otherwise(1 + k % 3).cast("int")
    docs = docs.withColumn("version", version)
    page = F.concat(F.lit("<!-- llm-wiki:page="), F.when(is_("PAGE_MARKS"), "2").otherwise("1"), F.lit(" source=ocr -->\n"))
    body = (
        F.when(F.col("version") == 1, F.concat(page, F.col("flat"), F.lit("\n"))).when(F.col("version") == 2, F.concat(page, F.lit("<!-- llm-wiki:block=b000001 -->\n"), F.col("flat"), F.lit("\n")))
        .otherwise(F.concat(F.when(is_("MARKS_LEFT"), page).otherwise(F.lit("```\n<!-- llm-wiki:page=9 -->\n```\n")), F.col("flat"), F.lit("\n")))
    )
    docs = docs.withColumn("body", body).withColumn("content_hash", F.sha2(F.when(is_("BODY_HASH"), F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256))
    bad = lambda name, right, wrong="other": F.when(is_(name), F.lit(wrong)).otherwise(right)
    head = F.concat_ws(
        "\n", F.concat(F.lit("schema_version: "), bad("SCHEMA_VERSION", F.col("version").cast("string"), "7")), F.concat(F.lit("kind: "), bad("KIND", F.lit("raw_document"))), F.concat(F.lit('source_id: "'), bad("SOURCE_ID", F.concat(F.lit("d"), k.cast("string"))), F.lit('"')),
        F.concat(F.lit("source_kind: '"), bad("SOURCE_KIND", F.lit("text")), F.lit("'")), F.concat(F.lit("source_hash: "), bad("SOURCE_HASH", F.sha2(k.cast("string"), 256))), F.concat(F.lit("content_hash: "), bad("CONTENT_HASH", F.col("content_hash"))),
        F.concat(F.lit("parser_id: "), bad("PARSER_ID", F.lit("plain"))), F.concat(F.lit('parser_version: "'), bad("PARSER_VERSION", F.lit("1.0")), F.lit('"')),
    )
    artifact = F.concat(F.when(is_("FRONT_MATTER"), F.lit("--\n")).otherwise(F.lit("---\n")), head, F.lit("\n---\n"), "body")
    path = F.concat(bad("PATH_OUTSIDE", F.lit("raw"), "raw/../x"), F.lit("/articles/d"), k.cast("string"), F.lit(".md"))
    docs = docs.withColumns({"artifact": artifact, "path": path, "id": F.concat(F.lit("d"), k.cast("string"))})
    map_path = F.when(((F.col("version") == 2) & ~is_("MAP_UNNAMED")) | is_("MAP_UNEXPECTED"), F.concat(F.lit("maps/"), "id"))
    entry = lambda block, start, end: F.struct(F.lit(block).alias("block_id"), start.cast("int").alias("start_line"), F.lit(end).cast("int").alias("end_line"))
    first = entry("b000001", F.when(is_("MAP_PLACE"), 2).otherwise(3), 3)
    entries = F.when(is_("MAP_REPEATED"), F.array(first, first)).when(is_("MAP_BLOCKS"), F.array(entry("b000002", F.lit(3), 3))).when(is_("MAP_LINES"), F.array(entry("b000001", F.lit(3), 9))).otherwise(F.array(first))
    # The file of one revision is gone, and a file that nobody claims is there instead.
    files = docs.select(F.when(is_("FILE_MISSING"), F.concat(F.lit("raw/loose/"), "id", F.lit(".md"))).otherwise(F.col("path")).alias("path"), "artifact").withColumnRenamed("artifact", "content")
    asset = F.concat(bad("ASSET_OUTSIDE", F.concat(F.lit("raw/assets/"), "id"), "raw/assets/other"), F.lit("/a.png"))
    return {
        "revisions": docs.select(
            F.col("id").alias("source_id"), F.sha2(k.cast("string"), 256).alias("source_hash"), F.lit("text").alias("source_kind"), F.lit(1).alias("revision"), F.col("version").alias("schema_version"), F.col("path").alias("raw_path"),
            F.sha2(F.when(is_("ARTIFACT_HASH"), F.concat("artifact", F.lit("!"))).otherwise(F.col("artifact")), 256).alias("artifact_hash"), "content_hash", F.lit("plain").alias("parser_id"), F.lit("1.0").alias("parser_version"),
            F.lit(1).alias("page_count"), map_path.alias("map_path"), F.when(map_path.isNotNull(), F.sha2("id", 256)).alias("map_hash")),
        "files": files,
        "maps": docs.where("version = 2").select(F.concat(F.lit("maps/"), "id").alias("path"), F.when(is_("MAP_UNREADABLE"), "other").otherwise(F.sha2("id", 256)).alias("hash"), F.col("id").alias("source_id"), bad("MAP_SOURCE", F.sha2(k.cast("string"), 256)).alias("source_hash"), "content_hash", entries.alias("entries")),
        "assets": docs.where("doc_id % 2 = 0 OR flaw LIKE 'ASSET%'").select(F.col("id").alias("source_id"), F.lit(1).alias("revision"), asset.alias("path"), F.lit("h1").alias("hash")),
        "objects": docs.select(F.when(is_("ASSET_MISSING"), F.concat(F.lit("gone/"), "id")).otherwise(F.concat(F.lit("raw/assets/"), "id", F.lit("/a.png"))).alias("path"), bad("ASSET_HASH", F.lit("h1"), "h2").alias("hash")),
        "manifests": docs.select(F.col("id").alias("source_id"), F.when(k % 43 == 5, "queued").otherwise("parsed").alias("status"), F.when(k % 47 == 6, 2).otherwise(1).alias("current_revision")),
    }


RAW_SQL = f"r AS (SELECT doc_id, 'd' || doc_id AS id, [{', '.join(repr(x) for x in RAW_FLAWS)}][doc_id % 41 + 1] AS code FROM documents)"


@query("raw_revisions", f"WITH {RAW_SQL} SELECT id AS source_id, 1 AS revision, code FROM r")
def raw_revisions(spark, d):
    c = raw_corpus(spark, d)
    return artifacts.verify_revisions(c["revisions"], c["files"], c["maps"], c["assets"], c["objects"])


@query("raw_checks", f"""WITH {RAW_SQL}, i AS (SELECT id AS subject, list_sort(list_filter([CASE WHEN code IS NOT NULL THEN 'RAW_INTEGRITY_FAILED: revision 1 ' || code END, CASE WHEN doc_id % 43 <> 5 AND doc_id % 47 = 6 THEN 'RAW_REVISION_MISSING' END, CASE WHEN doc_id % 53 = 7 THEN 'SOURCE_OBJECT_INVALID: OBJECT_MISSING' END], lambda x: x IS NOT NULL)) AS issues FROM r
        UNION ALL SELECT 'unmanaged:raw/loose/' || id || '.md', ['UNMANAGED_RAW_FILE'] FROM r WHERE code = 'FILE_MISSING' UNION ALL SELECT 'invalid-manifest:m' || doc_id, ['MANIFEST_INVALID: invalid_json'] FROM r WHERE doc_id % 59 = 8)
    SELECT subject, len(issues) = 0 AS ok, array_to_string(issues, '; ') AS issues FROM i""")
def raw_checks(spark, d):
    c = raw_corpus(spark, d)
    docs = table(spark, d, "documents")
    bad_manifests = docs.where("doc_id % 59 = 8").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("path"), F.lit("invalid_json").alias("code"))
    bad_objects = docs.where("doc_id % 53 = 7").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("OBJECT_MISSING").alias("code"))
    judged = artifacts.verify_revisions(c["revisions"], c["files"], c["maps"], c["assets"], c["objects"])
    found = artifacts.verification(c["manifests"], c["revisions"], judged, c["files"], bad_manifests, bad_objects)
    return found.select("subject", "ok", F.array_join("issues", "; ").alias("issues"))


@query("verified_originals", """SELECT 's' || doc_id AS source_id, CASE WHEN doc_id % 11 = 3 THEN 'OBJECT_MISSING' ELSE 'OBJECT_HASH_MISMATCH' END AS code FROM documents WHERE doc_id % 11 = 3 OR doc_id % 7 = 2""")
def verified_originals(spark, d):
    """Documents as stored originals: some are gone, some hold other bytes than the manifest says."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("o/"), k.cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    stored_ = rows.select(F.when(k % 11 == 3, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), F.when(k % 7 == 2, F.sha2(F.concat("hash", F.lit("!")), 256)).otherwise(F.col("hash")).alias("hash"))
    return intake.verify_originals(stored_, rows.select(F.concat(F.lit("s"), k.cast("string")).alias("source_id"), "path", "hash"))


@query("object_paths", "SELECT DISTINCT 'objects/sha256/' || substring(sha256(text), 1, 2) || '/' || sha256(text) || '.' || CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END AS path FROM documents WHERE text IS NOT NULL")
def object_paths(spark, d):
    """Where a content-addressed store keeps the documents; equal ones of a kind lie in one place."""
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select(intake.object_path(F.sha2("text", 256), F.when(F.col("doc_id") % 2 == 0, "md").otherwise("txt")).alias("path")).distinct()


@query("import_order", "SELECT doc_id AS id, row_number() OVER (ORDER BY importedAt DESC, doc_id) AS place FROM (SELECT doc_id, '2024-01-' || lpad(CAST(doc_id * 7 % 28 + 1 AS VARCHAR), 2, '0') AS importedAt FROM documents)")
def import_order(spark, d):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") * 7 % 28 + 1).cast("string"), 2, "0"))
    return manifests.by_import_time(table(spark, d, "documents").select(F.col("doc_id").alias("id"), day.alias("importedAt"))).select("id", "place")


@query("reusable_parses", """WITH w AS (SELECT o_orderkey AS k, o_custkey % 50 AS key FROM orders), v AS (SELECT key, max(k) AS revision FROM w WHERE k % 3 = 0 GROUP BY key) SELECT k, coalesce(revision, -1) AS revision FROM w LEFT JOIN v USING (key)""")
def reusable_parses(spark, d):
    """Orders as work whose key is a customer's; verified revisions are every third order's."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("parse_key"))
    reuse, parse = manifests.reusable(rows, rows.select("parse_key", F.col("k").alias("revision"), (F.col("k") % 3 == 0).alias("verified")))
    return reuse.select("k", "revision").unionByName(parse.select("k", F.lit(-1).cast("long").alias("revision")))


@query("live_checkpoints", """SELECT event_id AS job_id FROM events WHERE event_id % 5 <> 1 AND ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-02 12:00:00'""")
def live_checkpoints(spark, d):
    """Events as checkpoints of a day; the sources of every fifth have changed since."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k.alias("job_id"), k.alias("source_id"), F.sha2(k.cast("string"), 256).alias("source_hash"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).cast("timestamp").alias("expires_at"))
    now = table(spark, d, "events").select(k.alias("source_id"), F.sha2(F.when(k % 5 == 1, F.concat(k.cast("string"), F.lit("!"))).otherwise(k.cast("string")), 256).alias("hash"))
    return manifests.live_checkpoints(rows, now, F.lit("2024-01-02 12:00:00").cast("timestamp")).select("job_id")
