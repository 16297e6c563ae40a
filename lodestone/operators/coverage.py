"""Coverage of sources by knowledge decisions, staging, and verification of raw texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a decision can be about, its folder, and what it can be.
FOLDERS = {"entity": "wiki/entities/", "concept": "wiki/concepts/", "synthesis": "wiki/synthesis/"}
DECISIONS = ["created", "updated", "already_covered", "insufficient_evidence", "user_rejected"]


def assessments(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, type, n_candidates, outcome for every source and each of the types.
    Candidates are counted by source and type first, so a busy source costs three rows."""
    kinds = F.explode(F.array(*map(F.lit, FOLDERS))).alias("type")
    counted = candidates.groupBy("source_id", "type").agg(F.count(F.lit(1)).alias("n"))
    every = sources.select("source_id").distinct().select("source_id", kinds).join(counted, ["source_id", "type"], "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("source_id", "type", n.alias("n_candidates"), F.when(n > 0, "candidates_found").otherwise("none").alias("outcome"))


def decide(candidates: DataFrame) -> DataFrame:
    """Candidates as decisions: an open one has insufficient evidence."""
    return candidates.withColumn("decision", F.coalesce("decision", F.lit("insufficient_evidence")))


def select_decisions(decisions: DataFrame, selected: DataFrame) -> DataFrame:
    """Created and updated decisions outside the selection (candidate_id) are rejected."""
    chosen = selected.select("candidate_id", F.lit(True).alias("chosen")).distinct()
    writes = F.col("decision").isin("created", "updated")
    return decisions.join(chosen, "candidate_id", "left").withColumn("decision", F.when(writes & F.col("chosen").isNull(), "user_rejected").otherwise(F.col("decision"))).drop("chosen")


def stage(decisions: DataFrame, pages: DataFrame) -> DataFrame:
    """candidate_id, target_path, decision: created becomes updated where the page exists
    and the other way round; what would change nothing is already covered."""
    now = pages.select(F.col("path").alias("target_path"), F.col("content").alias("now"))
    writes = F.col("decision").isin("created", "updated")
    decision = (
        F.when(~writes, F.col("decision")).when(F.col("now").isNull(), "created")
        .when(F.col("now") == F.col("content"), "already_covered").otherwise("updated")
    )
    return decisions.join(now, "target_path", "left").select("candidate_id", "target_path", decision.alias("decision"))


def issues(sources: DataFrame, assessed: DataFrame, decisions: DataFrame) -> DataFrame:
    """code, source_id, n: every rule that a coverage report breaks, counted by source.

    Rules: unknown sources, missing or wrong assessments, decisions of no known kind,
    paths outside their type's folder, and candidate ids that occur more than once."""
    known = sources.select("source_id").distinct()
    due = assessments(known, decisions).select("source_id", "type", F.col("outcome").alias("due"))
    said = assessed.select("source_id", "type", "outcome")
    compared = due.join(said, ["source_id", "type"], "left")
    folder = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    flaws = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin(*FOLDERS), F.lit(False)), "invalid_type"),
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "invalid_decision"),
        F.when(F.col("decision").isin("created", "updated") & ~F.coalesce(F.col("target_path").startswith(F.try_element_at(folder, F.col("type"))), F.lit(False)), "path_outside_type"),
    ))
    again = decisions.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("k"), F.min("source_id").alias("source_id")).where("k > 1")
    found = [
        decisions.join(known, "source_id", "left_anti").select(F.lit("unknown_source").alias("code"), "source_id"),
        said.join(known, "source_id", "left_anti").select(F.lit("unknown_source").alias("code"), "source_id"),
        compared.where("outcome IS NULL").select(F.lit("missing_assessment").alias("code"), "source_id"),
        compared.where("outcome <> due").select(F.lit("wrong_outcome").alias("code"), "source_id"),
        decisions.select(F.explode(flaws).alias("code"), "source_id"),
        again.select(F.lit("duplicate_candidate").alias("code"), "source_id"),
    ]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("code", "source_id").agg(F.count(F.lit(1)).alias("n"))


def raw_issues(raw: DataFrame) -> DataFrame:
    """doc_id, code: raw texts (doc_id, text, recorded_hash) that are missing, differ from
    their recorded hash, hold replacement characters or leave a code fence open."""
    marks = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^ {0,3}(```|~~~)"), F.lit(1)), lambda m: F.substring(m, 1, 1))
    # The marker that opened a fence closes it; other markers inside it are text.
    left_open = F.aggregate(marks, F.lit(""), lambda held, m: F.when(held == "", m).when(held == m, F.lit("")).otherwise(held)) != ""
    codes = F.array(
        F.when(F.col("text").isNull(), "missing_text"),
        F.when(F.sha2("text", 256) != F.col("recorded_hash"), "hash_mismatch"),
        F.when(F.col("text").contains("�"), "replacement_character"),
        F.when(left_open, "open_fence"),
    )
    return raw.select("doc_id", F.explode(F.array_compact(codes)).alias("code"))
