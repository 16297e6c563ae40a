"""Reports of an ingest against what was staged: source pages, decisions, coverage.

Everything is keyed by report_id, so reports of any number are worked on together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.functions import text as T
from lodestone.operators.index import KNOWLEDGE

#: The folder of each type of knowledge page, decisions, and pieces of evidence that a candidate keeps.
TYPE_OF_FOLDER = {folder: kind for kind, folder in names.FOLDERS.items()}
MADE, MOST_EVIDENCE = ("created", "updated"), 64
SOURCES = r"^wiki/sources?/"


def type_of_path(path: Column) -> Column:
    """The type of knowledge page that a path's folder holds; null elsewhere."""
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_OF_FOLDER.items() for x in pair])
    return F.try_element_at(kinds, F.nullif(F.regexp_extract(T.vault_path(path), r"^wiki/([^/]+)/", 1), F.lit("")))


def source_pages(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """source_id, path: pages (path, raw_path, raw_hash) of a source (source_id, raw_path,
    raw_hash), by either key. Two equi-joins, since an OR would compare all with all."""
    p = pages.select("path", F.col("raw_path").alias("p"), F.col("raw_hash").alias("h"))
    by_path = sources.join(p, F.col("raw_path") == F.col("p")).select("source_id", "path")
    by_hash = sources.join(p, F.col("raw_hash") == F.col("h")).select("source_id", "path")
    return by_path.unionByName(by_hash).distinct()


def stage_sources(sources: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, action, path, related: what becomes of the page of each source (source_id,
    raw_path, raw_hash, slug).

    The page that belongs to it is updated; several are "ambiguous" and have no path. Else one
    is created, named by the slug, or by a part of the hash where the slug is blank; a name
    that is taken gets that part behind it. Related are the pages of its candidates (source_id,
    target_path), sorted.
    """
    matched = source_pages(sources, pages).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("own"))
    part = F.substring("raw_hash", 1, 8)
    slug = F.coalesce(F.nullif(names.slug(F.coalesce("slug", F.lit(""))), F.lit("")), F.concat(F.lit("source-"), part))
    made = sources.join(matched, "source_id", "left").withColumn("first", F.concat(F.lit("wiki/sources/"), slug, F.lit(".md")))
    taken = pages.select(F.col("path").alias("first"), F.lit(True).alias("taken")).distinct()
    made = made.join(taken, "first", "left").withColumn("second", F.concat(F.lit("wiki/sources/"), slug, F.lit("-"), part, F.lit(".md")))
    related = candidates.where("target_path IS NOT NULL").groupBy("source_id").agg(F.array_sort(F.collect_set(T.page_key(F.col("target_path")))).alias("related"))
    path = F.when(F.col("n") == 1, F.col("own")).when(F.col("n").isNull(), F.when(F.col("taken"), F.col("second")).otherwise(F.col("first")))
    action = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "update").otherwise("create")
    return made.join(related, "source_id", "left").select("source_id", action.alias("action"), path.alias("path"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def apply_decisions(candidates: DataFrame, inputs: DataFrame, matches: DataFrame, pages: DataFrame) -> DataFrame:
    """report_id, candidate_id, decision, type, target_path, prevented, corrected: decisions
    (inputs: report_id, candidate_id, decision, target_path, type) as they take effect on
    candidates (report_id, candidate_id, type).

    The type is that of the target page (path, type) where it exists, else the one asked for,
    else the proposed one. A creation of what a page is already, by an exact match (report_id,
    candidate_id, path, rank), becomes an update of that page. A candidate without a decision
    has a null one.
    """
    exact = matches.groupBy("report_id", "candidate_id").agg(F.min_by("path", F.struct("rank", "path")).alias("exact_path"))
    given = inputs.select("report_id", "candidate_id", "decision", T.vault_path(F.nullif("target_path", F.lit(""))).alias("given"), F.when(F.col("type").isin(KNOWLEDGE), F.col("type")).alias("asked"))
    rows = candidates.withColumnRenamed("type", "proposed").join(given, ["report_id", "candidate_id"], "left").join(exact, ["report_id", "candidate_id"], "left")
    prevented = F.coalesce((F.col("decision") == "created") & F.col("exact_path").isNotNull(), F.lit(False))
    rows = rows.withColumn("prevented", prevented).withColumn("target_path", F.when(F.col("prevented"), F.col("exact_path")).otherwise(F.col("given")))
    kinds = pages.select(F.col("path").alias("target_path"), F.col("type").alias("page_type")).dropDuplicates(["target_path"])
    rows = rows.join(kinds, "target_path", "left").withColumn("type", F.coalesce("page_type", "asked", "proposed"))
    return rows.select("report_id", "candidate_id", F.when(F.col("prevented"), "updated").otherwise(F.col("decision")).alias("decision"), "type", "target_path", "prevented", (F.col("type") != F.col("proposed")).alias("corrected"))


def decision_counts(applied: DataFrame) -> DataFrame:
    """report_id, prevented, corrected, undecided."""
    n = lambda c: F.count_if(c)
    return applied.groupBy("report_id").agg(n(F.col("prevented")).alias("prevented"), n(F.col("corrected")).alias("corrected"), n(F.col("decision").isNull()).alias("undecided"))


def _typed(decisions: DataFrame) -> DataFrame:
    """Decisions without those about source pages, typed by the folder of their target."""
    path = T.vault_path(F.col("target_path"))
    kept = decisions.where(~F.coalesce(path.rlike(SOURCES), F.lit(False)))
    return kept.withColumn("type", F.coalesce(type_of_path(F.col("target_path")), "type"))


def _unrepresented(decisions: DataFrame, staged: DataFrame) -> DataFrame:
    """report_id, path, action, type of staged knowledge pages without a decision that made them."""
    done = decisions.where(F.col("decision").isin(*MADE)).select("report_id", T.vault_path(F.col("target_path")).alias("path"), F.when(F.col("decision") == "created", "create").otherwise("update").alias("action")).distinct()
    pages = staged.where(~F.col("path").startswith("wiki/sources/")).select("report_id", "path", "action", type_of_path(F.col("path")).alias("type")).where("type IS NOT NULL")
    return pages.join(done, ["report_id", "path", "action"], "left_anti")


def reconcile(decisions: DataFrame, assessments: DataFrame, staged: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, assessments) as the staged pages prove them.

    decisions: report_id, candidate_id, source_id, type, decision, target_path. assessments:
    report_id, source_id, type, outcome, reason. staged: report_id, path, action. evidence:
    report_id, path, source_id of verified evidence from sources of the report.

    Decisions about source pages go, and types follow the folder. A staged page that no
    decision stands for gets one for each source of its evidence, under an id that is free.
    Outcomes follow from the decisions there are; what lacks an assessment for a decision that
    was added gets one, and blank reasons are filled.
    """
    kept = _typed(decisions)
    extra = _unrepresented(kept, staged).join(evidence.select("report_id", "path", "source_id").distinct(), ["report_id", "path"])
    extra = extra.withColumn("base", F.concat(F.lit("host:"), F.col("source_id").cast("string"), F.lit(":"), "path"))
    # Only ids that look like a host's can be in the way.
    known = kept.where(F.col("candidate_id").startswith("host:")).select("report_id", F.col("candidate_id").alias("base")).distinct()
    numbered = known.select("report_id", F.regexp_extract("base", r"^(.*):([2-9]|[1-9][0-9]{1,8})$", 1).alias("base"), F.regexp_extract("base", r"^(.*):([2-9]|[1-9][0-9]{1,8})$", 2).cast("int").alias("k")).where("base <> ''")
    used = numbered.groupBy("report_id", "base").agg(F.collect_set("k").alias("used"))
    extra = extra.join(known.withColumn("taken", F.lit(True)), ["report_id", "base"], "left").join(used, ["report_id", "base"], "left")
    free = F.element_at(F.array_except(F.sequence(F.lit(2), F.coalesce(F.size("used"), F.lit(0)) + 2), F.coalesce("used", F.array().cast("array<int>"))), 1)
    name = F.when(F.coalesce("taken", F.lit(False)), F.concat("base", F.lit(":"), free.cast("string"))).otherwise(F.col("base"))
    added = extra.select("report_id", name.alias("candidate_id"), "source_id", "type", F.when(F.col("action") == "create", "created").otherwise("updated").alias("decision"), F.col("path").alias("target_path"))
    whole = kept.select(*added.columns).unionByName(added)

    key = ["report_id", "source_id", "type"]
    have = whole.select(*key).distinct().withColumn("found", F.lit(True))
    blank = F.coalesce(T.trimmed(F.col("reason")), F.lit("")) == ""
    there = assessments.select(*key, "reason").join(have, key, "left")
    told = there.select(*key, F.when(F.col("found"), "candidates_found").otherwise("none").alias("outcome"), F.when(~blank, F.col("reason")).when(F.col("found"), "decisions_present").otherwise("nothing_kept").alias("reason"))
    new = added.select(*key).distinct().join(assessments.select(*key), key, "left_anti").select(*key, F.lit("candidates_found").alias("outcome"), F.lit("staged_pages").alias("reason"))
    return whole, told.unionByName(new)


def conflicts(decisions: DataFrame, staged: DataFrame) -> DataFrame:
    """report_id, path, code: decisions and staged pages that do not agree, by a full join:
    page_not_staged, action_differs, not_represented."""
    done = decisions.where(F.col("decision").isin(*MADE) & F.col("target_path").isNotNull()).groupBy("report_id", T.vault_path(F.col("target_path")).alias("path")).agg(F.collect_set(F.when(F.col("decision") == "created", "create").otherwise("update")).alias("made"))
    pages = staged.select("report_id", "path", "action").distinct()
    joined = done.join(pages, ["report_id", "path"], "full")
    code = (
        F.when(F.col("action").isNull(), "page_not_staged").when(F.col("made").isNull(), F.when(~F.col("path").startswith("wiki/sources/"), "not_represented"))
        .when((F.size("made") > 1) | ~F.array_contains("made", F.col("action")), "action_differs")
    )
    return joined.select("report_id", "path", code.alias("code")).where("code IS NOT NULL")


def scope_issues(reported: DataFrame, expected: DataFrame) -> DataFrame:
    """report_id, source_id, code: sources that a report names twice (repeated), should not
    (unexpected) or does not name (missing)."""
    n = reported.groupBy("report_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    asked = expected.select("report_id", "source_id").distinct().withColumn("asked", F.lit(True))
    joined = n.join(asked, ["report_id", "source_id"], "full")
    code = F.when(F.col("asked").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return joined.select("report_id", "source_id", code.alias("code")).where("code IS NOT NULL")


def analysis_issues(candidates: DataFrame, assessments: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """report_id, code, subject, once each, of an analysis before decisions are made.

    candidates: report_id, candidate_id, source_id, type, evidence_ids. assessments: report_id,
    source_id, type, outcome, reason. sources: report_id, source_id. evidence: report_id,
    evidence_id that was read. Codes: unknown_source, repeated_candidate, unknown_evidence,
    repeated_assessment, none_but_found, found_but_none, no_reason, no_assessment.
    """
    pair = F.concat(F.col("source_id").cast("string"), F.lit("/"), F.col("type"))
    issue = lambda df, code, subject: df.select("report_id", F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    known = sources.select("report_id", "source_id").distinct()
    cited = candidates.select("report_id", "candidate_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    lost = cited.join(evidence.select("report_id", "evidence_id").distinct(), ["report_id", "evidence_id"], "left_anti")
    again = candidates.where("candidate_id IS NOT NULL").groupBy("report_id", "candidate_id").count().where("count > 1")
    key = ["report_id", "source_id", "type"]
    counts = candidates.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    judged = assessments.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cells = known.select("report_id", "source_id", F.explode(F.array(*map(F.lit, KNOWLEDGE))).alias("type"))
    found = [
        issue(candidates.join(known, ["report_id", "source_id"], "left_anti"), "unknown_source", F.coalesce("candidate_id", F.lit(""))),
        issue(again, "repeated_candidate", F.col("candidate_id")),
        issue(lost, "unknown_evidence", F.concat_ws("/", "candidate_id", "evidence_id")),
        issue(assessments.groupBy(*key).count().where("count > 1"), "repeated_assessment", pair),
        issue(judged.where("outcome = 'none' AND n > 0"), "none_but_found", pair),
        issue(judged.where("outcome = 'candidates_found' AND n = 0"), "found_but_none", pair),
        issue(judged.where(F.coalesce(T.trimmed(F.col("reason")), F.lit("")) == ""), "no_reason", pair),
        issue(cells.join(assessments, key, "left_anti"), "no_assessment", pair),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def kept_evidence(candidates: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """Candidates with their distinct evidence_ids in the order given, `most` at most: that a
    candidate has more is no reason to refuse it."""
    return candidates.withColumn("evidence_ids", F.slice(F.array_distinct("evidence_ids"), 1, most))


def source_outcomes(decisions: DataFrame) -> DataFrame:
    """report_id, source_id, decisions, any_excluded: whether a decision made no page."""
    return decisions.groupBy("report_id", "source_id").agg(F.count(F.lit(1)).alias("decisions"), F.bool_or(~F.col("decision").isin(*MADE)).alias("any_excluded"))


def last_decisions(inputs: DataFrame) -> DataFrame:
    """Of inputs for one candidate the last by `ord`."""
    last = Window.partitionBy("report_id", "candidate_id").orderBy(F.desc("ord"))
    return inputs.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
