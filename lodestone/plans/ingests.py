"""Queries over reports of ingests, with their SQL. Orders are reports' candidates, of the
customers' nations as reports; flaws come by the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import ingest
from lodestone.plans.register import query
from lodestone.sources.derived import table

FOLDER = {"entity": "entities", "concept": "concepts", "synthesis": "synthesis"}
KINDS = ["entity", "concept", "synthesis"]


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


@query("staged_sources", """WITH d AS (SELECT doc_id AS k, 'd' || doc_id AS source_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
    s AS (SELECT *, CASE WHEN k % 7 = 5 THEN 'source-' || substring(h, 1, 8) ELSE 'doc-' || (k - k % 2) END AS slug FROM d),
    pages AS (SELECT 'wiki/sources/doc-' || k || '.md' AS path, k FROM d WHERE k % 7 < 4)
    SELECT source_id, CASE WHEN k % 7 = 3 THEN 'ambiguous' WHEN k % 7 < 2 THEN 'update' ELSE 'create' END AS action, CASE WHEN k % 7 = 3 THEN NULL WHEN k % 7 < 2 THEN 'wiki/sources/doc-' || k || '.md'
        WHEN 'wiki/sources/' || slug || '.md' IN (SELECT path FROM pages) THEN 'wiki/sources/' || slug || '-' || substring(h, 1, 8) || '.md' ELSE 'wiki/sources/' || slug || '.md' END AS path,
        CASE WHEN k % 3 = 0 THEN 'wiki/concepts/x' || k % 5 || ';wiki/entities/y' ELSE '' END AS related FROM s""")
def staged_sources(spark, d):
    k = F.col("doc_id")
    id_, digest, raw = F.concat(F.lit("d"), k.cast("string")), F.sha2(k.cast("string"), 256), F.concat(F.lit("raw/"), k.cast("string"), F.lit(".md"))
    docs = table(spark, d, "documents").select("doc_id")
    sources = docs.select(id_.alias("source_id"), raw.alias("raw_path"), digest.alias("raw_hash"), F.when(k % 7 == 5, " - ").otherwise(F.concat(F.lit("Doc "), (k - k % 2).cast("string"))).alias("slug"))
    path = lambda name: F.concat(F.lit(name), k.cast("string"), F.lit(".md"))
    pages = docs.where("doc_id % 7 < 4").select(path("wiki/sources/doc-").alias("path"), F.when((k % 7).isin(0, 3), raw).alias("raw_path"), F.when(k % 7 == 1, digest).alias("raw_hash"))
    pages = pages.unionByName(docs.where("doc_id % 7 IN (1, 3)").select(F.when(k % 7 == 1, path("wiki/sources/doc-")).otherwise(path("wiki/sources/more-")).alias("path"), F.when(k % 7 == 1, raw).alias("raw_path"), digest.alias("raw_hash")))
    candidates = docs.where("doc_id % 3 = 0").select(id_.alias("source_id"), F.explode(F.array(F.concat(F.lit("wiki/concepts/x"), (k % 5).cast("string"), F.lit(".md")), F.lit("wiki/entities/y.md"), F.lit(None).cast("string"))).alias("target_path"))
    return ingest.stage_sources(sources, pages, candidates).select("source_id", "action", "path", F.array_join("related", ";").alias("related"))


def _candidates(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("r"), (F.col("o_custkey") % 25).cast("string")).alias("report_id"), F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("source_id"))
    return rows.withColumn("type", _pick(KINDS, F.col("k") % 3))


CANDIDATES = "c AS (SELECT o_orderkey AS k, 'r' || o_custkey % 25 AS report_id, 'c' || o_orderkey AS candidate_id, 's' || o_orderkey % 4 AS source_id, ['entity', 'concept', 'synthesis'][o_orderkey % 3 + 1] AS type FROM orders)"


def _applied(spark, d):
    rows, k = _candidates(spark, d), F.col("k")
    page = lambda folder: F.concat(F.lit(f"wiki/{folder}/p"), k.cast("string"), F.lit(".md"))
    decided = rows.where("k % 17 <> 4")
    inputs = decided.select("report_id", "candidate_id", F.when(k % 5 == 0, "already_covered").when(k % 2 == 0, "created").otherwise("updated").alias("decision"), F.when(k % 6 == 0, F.concat(F.lit("/"), page("concepts"))).alias("target_path"), F.when(k % 8 == 0, "synthesis").when(k % 9 == 0, "odd").alias("type"))
    matches = rows.where("k % 7 = 0").select("report_id", "candidate_id", F.explode(F.array(F.struct(page("synthesis").alias("path"), F.lit(1).alias("rank")), F.struct(page("entities").alias("path"), F.lit(2).alias("rank")))).alias("m")).select("report_id", "candidate_id", "m.*")
    pages = rows.where("k % 4 < 3").select(page("concepts").alias("path"), F.lit("concept").alias("type")).unionByName(rows.where("k % 7 = 0").select(page("synthesis").alias("path"), F.lit("synthesis").alias("type")))
    return ingest.apply_decisions(rows.select("report_id", "candidate_id", "type"), inputs, matches, pages)


APPLIED = f"""{CANDIDATES}, i AS (SELECT *, CASE WHEN k % 17 = 4 THEN NULL WHEN k % 5 = 0 THEN 'already_covered' WHEN k % 2 = 0 THEN 'created' ELSE 'updated' END AS dec, CASE WHEN k % 17 <> 4 AND k % 6 = 0 THEN 'wiki/concepts/p' || k || '.md' END AS given, CASE WHEN k % 17 <> 4 AND k % 8 = 0 THEN 'synthesis' END AS asked FROM c),
    j AS (SELECT *, coalesce(dec = 'created' AND k % 7 = 0, false) AS prevented FROM i),
    a AS (SELECT report_id, candidate_id, CASE WHEN prevented THEN 'updated' ELSE dec END AS decision, CASE WHEN prevented THEN 'synthesis' WHEN given IS NOT NULL AND k % 4 < 3 THEN 'concept' ELSE coalesce(asked, type) END AS type, CASE WHEN prevented THEN 'wiki/synthesis/p' || k || '.md' ELSE given END AS target_path, prevented, type AS proposed FROM j)"""


@query("applied_decisions", f"WITH {APPLIED} SELECT * EXCLUDE (proposed), type <> proposed AS corrected FROM a")
def applied_decisions(spark, d):
    return _applied(spark, d)


@query("decision_counts", f"WITH {APPLIED} SELECT report_id, count(*) FILTER (prevented) AS prevented, count(*) FILTER (type <> proposed) AS corrected, count(*) FILTER (decision IS NULL) AS undecided FROM a GROUP BY 1")
def decision_counts(spark, d):
    return ingest.decision_counts(_applied(spark, d))


def _report(spark, d):
    rows, k = _candidates(spark, d), F.col("k")
    folder = _pick([FOLDER[x] for x in KINDS], (F.col("k") + F.when(k % 10 == 1, 1).otherwise(0)) % 3)
    path = F.concat(F.lit("wiki/"), folder, F.lit("/p"), k.cast("string"), F.lit(".md"))
    target = F.when(k % 12 == 5, F.concat(F.lit("/wiki/sources/p"), k.cast("string"))).when(k % 12 == 7, F.lit(None)).otherwise(path)
    decision = F.when(k % 12 == 7, "source_only").when(k % 2 == 0, "created").otherwise("updated")
    decisions = rows.where("k % 13 <> 6").select("report_id", F.when(k % 13 == 5, F.concat(F.lit("host:s"), (k % 4).cast("string"), F.lit(":wiki/entities/h"), k.cast("string"), F.lit(".md"))).otherwise(F.col("candidate_id")).alias("candidate_id"), "source_id", "type", decision.alias("decision"), target.alias("target_path"))
    action = F.when((k % 2 == 0) != (k % 15 == 2), "create").otherwise("update")
    staged = rows.where("k % 12 NOT IN (5, 7) AND k % 14 <> 3").select("report_id", path.alias("path"), action.alias("action"), "source_id")
    hosts = rows.where("k % 13 = 5").select("report_id", F.concat(F.lit("wiki/entities/h"), k.cast("string"), F.lit(".md")).alias("path"), F.lit("create").alias("action"), "source_id")
    staged = staged.unionByName(hosts)
    cells = rows.where("k % 12 <> 5").select("report_id", "source_id", "type").distinct()
    assessments = cells.where("NOT (report_id = 'r3' AND source_id = 's1')").select("*", F.lit("none").alias("outcome"), F.when(F.col("source_id") == "s2", " ").otherwise("why").alias("reason"))
    return decisions, assessments, staged.select("report_id", "path", "action"), staged.select("report_id", "path", "source_id")


REPORT = f"""{CANDIDATES}, f AS (SELECT *, ['entities', 'concepts', 'synthesis'][(k + CASE WHEN k % 10 = 1 THEN 1 ELSE 0 END) % 3 + 1] AS folder, ['entity', 'concept', 'synthesis'][(k + CASE WHEN k % 10 = 1 THEN 1 ELSE 0 END) % 3 + 1] AS ftype, k % 12 IN (5, 7) AS pageless FROM c),
    p AS (SELECT *, 'wiki/' || folder || '/p' || k || '.md' AS path, 'host:' || source_id || ':wiki/entities/h' || k || '.md' AS host FROM f),
    dec AS (SELECT report_id, CASE WHEN k % 13 = 5 THEN host ELSE candidate_id END AS candidate_id, source_id, CASE WHEN k % 12 = 7 THEN type ELSE ftype END AS type, CASE WHEN k % 12 = 7 THEN 'source_only' WHEN k % 2 = 0 THEN 'created' ELSE 'updated' END AS decision, CASE WHEN k % 12 <> 7 THEN path END AS target_path FROM p WHERE k % 13 <> 6 AND k % 12 <> 5),
    staged AS (SELECT report_id, path, CASE WHEN (k % 2 = 0) <> (k % 15 = 2) THEN 'create' ELSE 'update' END AS action, source_id, ftype, 'host:' || source_id || ':' || path AS base, NULL AS taken FROM p WHERE NOT pageless AND k % 14 <> 3
        UNION ALL SELECT report_id, 'wiki/entities/h' || k || '.md', 'create', source_id, 'entity', host, k % 12 <> 5 FROM p WHERE k % 13 = 5),
    extra AS (SELECT report_id, CASE WHEN taken THEN base || ':2' ELSE base END AS candidate_id, source_id, ftype AS type, CASE WHEN action = 'create' THEN 'created' ELSE 'updated' END AS decision, path AS target_path FROM staged s
        WHERE NOT EXISTS (SELECT 1 FROM dec d WHERE d.report_id = s.report_id AND d.target_path = s.path AND d.decision = CASE WHEN s.action = 'create' THEN 'created' ELSE 'updated' END)),
    whole AS (SELECT * FROM dec UNION ALL SELECT * FROM extra),
    cells AS (SELECT DISTINCT report_id, source_id, type, CASE WHEN source_id = 's2' THEN ' ' ELSE 'why' END AS reason FROM c WHERE k % 12 <> 5 AND NOT (report_id = 'r3' AND source_id = 's1'))"""


@query("reconciled_decisions", f"WITH {REPORT} SELECT * FROM whole")
def reconciled_decisions(spark, d):
    return ingest.reconcile(*_report(spark, d))[0]


@query("reconciled_assessments", f"""WITH {REPORT}, t AS (SELECT *, EXISTS (SELECT 1 FROM whole w WHERE w.report_id = cells.report_id AND w.source_id = cells.source_id AND w.type = cells.type) AS found FROM cells)
    SELECT report_id, source_id, type, CASE WHEN found THEN 'candidates_found' ELSE 'none' END AS outcome, CASE WHEN trim(reason) <> '' THEN reason WHEN found THEN 'decisions_present' ELSE 'nothing_kept' END AS reason FROM t
    UNION ALL SELECT DISTINCT report_id, source_id, type, 'candidates_found', 'staged_pages' FROM extra e WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.report_id = e.report_id AND x.source_id = e.source_id AND x.type = e.type)""")
def reconciled_assessments(spark, d):
    return ingest.reconcile(*_report(spark, d))[1]


@query("coverage_conflicts", f"""WITH {REPORT}, m AS (SELECT report_id, target_path AS path, min(CASE WHEN decision = 'created' THEN 'create' ELSE 'update' END) AS made FROM dec WHERE target_path IS NOT NULL GROUP BY 1, 2)
    SELECT coalesce(m.report_id, s.report_id) AS report_id, coalesce(m.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'page_not_staged' WHEN m.path IS NULL THEN 'not_represented' ELSE 'action_differs' END AS code
    FROM m FULL JOIN staged s ON m.report_id = s.report_id AND m.path = s.path WHERE s.path IS NULL OR m.path IS NULL OR made <> action""")
def coverage_conflicts(spark, d):
    decisions, _, staged, _ = _report(spark, d)
    return ingest.conflicts(ingest._typed(decisions), staged)


@query("scope_issues", """WITH r AS (SELECT DISTINCT 'r' || c_nationkey AS report_id, 's' || c_custkey % 40 AS source_id, c_custkey % 40 AS s FROM customer) SELECT report_id, source_id, CASE WHEN s % 7 = 3 THEN 'missing' WHEN s % 11 = 5 THEN 'unexpected' ELSE 'repeated' END AS code FROM r WHERE s % 7 = 3 OR s % 11 = 5 OR s % 13 = 6""")
def scope_issues(spark, d):
    k = F.col("s")
    rows = table(spark, d, "customer").select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("report_id"), (F.col("c_custkey") % 40).alias("s")).distinct().withColumn("source_id", F.concat(F.lit("s"), k.cast("string")))
    told = rows.where("s % 7 <> 3").select("report_id", F.explode(F.array_repeat("source_id", F.when(k % 13 == 6, 2).otherwise(1))).alias("source_id"))
    return ingest.scope_issues(told, rows.where("NOT (s % 11 = 5 AND s % 7 <> 3)").select("report_id", "source_id"))


@query("analysis_issues", f"""WITH {CANDIDATES}, x AS (SELECT *, CASE WHEN k % 19 = 2 THEN 's99' ELSE source_id END AS sid, CASE WHEN k % 23 = 4 THEN 'same' ELSE candidate_id END AS cid FROM c),
    src AS (SELECT DISTINCT report_id, source_id FROM c), n AS (SELECT report_id, sid AS source_id, type, count(*) AS n FROM x GROUP BY ALL),
    cell AS (SELECT report_id, source_id, unnest(['entity', 'concept', 'synthesis']) AS type FROM src), told AS (SELECT *, source_id = 's1' AND type = 'concept' AS none, source_id = 's2' AND type = 'entity' AS twice, source_id = 's3' AND type = 'entity' AS blank FROM cell WHERE NOT (source_id = 's0' AND type = 'synthesis'))
    SELECT DISTINCT * FROM (
    SELECT report_id, 'unknown_source' AS code, cid AS subject FROM x WHERE sid = 's99' UNION ALL SELECT report_id, 'repeated_candidate', cid FROM x GROUP BY 1, 3 HAVING count(*) > 1
    UNION ALL SELECT report_id, 'unknown_evidence', cid || '/e-lost' FROM x WHERE k % 29 = 3 UNION ALL SELECT report_id, 'repeated_assessment', source_id || '/' || type FROM told WHERE twice
    UNION ALL SELECT t.report_id, 'none_but_found', t.source_id || '/' || t.type FROM told t JOIN n USING (report_id, source_id, type) WHERE none
    UNION ALL SELECT t.report_id, 'found_but_none', t.source_id || '/' || t.type FROM told t ANTI JOIN n USING (report_id, source_id, type) WHERE NOT none
    UNION ALL SELECT report_id, 'no_reason', source_id || '/' || type FROM told WHERE blank UNION ALL SELECT report_id, 'no_assessment', source_id || '/' || type FROM cell WHERE source_id = 's0' AND type = 'synthesis')""")
def analysis_issues(spark, d):
    rows, k = _candidates(spark, d), F.col("k")
    ids = F.array(F.lit("e1"), F.when(k % 29 == 3, "e-lost").otherwise("e2"), F.lit("e1"))
    found = rows.select("report_id", F.when(k % 23 == 4, "same").otherwise(F.col("candidate_id")).alias("candidate_id"), F.when(k % 19 == 2, "s99").otherwise(F.col("source_id")).alias("source_id"), "type", ids.alias("evidence_ids"))
    sources = rows.select("report_id", "source_id").distinct()
    s, t = F.col("source_id"), F.col("type")
    cells = sources.select("*", F.explode(F.array(*map(F.lit, KINDS))).alias("type")).where(~((s == "s0") & (t == "synthesis")))
    told = cells.select("*", F.when((s == "s1") & (t == "concept"), "none").otherwise("candidates_found").alias("outcome"), F.when((s == "s3") & (t == "entity"), "\n").otherwise("why").alias("reason"), F.explode(F.when((s == "s2") & (t == "entity"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("x")).drop("x")
    evidence = sources.select("report_id").distinct().select("report_id", F.explode(F.array(F.lit("e1"), F.lit("e2"))).alias("evidence_id"))
    return ingest.analysis_issues(ingest.kept_evidence(found), told, sources, evidence)
