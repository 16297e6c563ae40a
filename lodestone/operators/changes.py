"""Change sets: plan checks, apply, rollback and receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import index
from lodestone.operators import pages as P


def with_hash(pages: DataFrame) -> DataFrame:
    return pages.select("path", "content", F.sha2("content", 256).alias("hash"))


def plan_checks(ops: DataFrame, current: DataFrame) -> DataFrame:
    """ord, path, code: every rule an operation (ord, action, path, expected_hash, content)
    breaks against the current pages (path, content, hash).

    Content must parse as a page, state the fields of its type, and link only to pages that
    exist or are planned. An update without an expected hash, or with an empty one, takes the current one. Of
    operations on one path all but the first are refused.
    """
    ops = ops.withColumn("path", T.vault_path(F.col("path")))
    joined = ops.join(current.select("path", F.col("hash").alias("now")), "path", "left")
    joined = joined.withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("ord")))
    create, update = F.col("action") == "create", F.col("action") == "update"
    blank = T.collapse(F.coalesce("content", F.lit(""))) == ""
    codes = F.array(
        F.when(~F.coalesce(create | update, F.lit(False)), "invalid_action"),
        F.when(~T.writable_path(F.col("path")), "path_not_writable"),
        F.when(~F.col("path").endswith(".md"), "not_markdown"),
        F.when(blank, "blank_content"),
        F.when(create & F.col("now").isNotNull(), "already_exists"),
        F.when(update & F.col("now").isNull(), "missing_page"),
        F.when(update & (F.col("expected_hash") != "") & (F.col("now") != F.col("expected_hash")), "stale_hash"),
        F.when(F.col("turn") > 1, "repeated_path"),
    )
    direct = joined.select("ord", "path", F.explode(F.array_compact(codes)).alias("code"))
    files = ops.where(~blank).select(F.concat_ws("#", "ord", "path").alias("path"), "content", "ord", F.col("path").alias("own"))
    parsed = P.parse_pages(files).withColumn("ord", F.substring_index("path", "#", 1).cast(dict(ops.dtypes)["ord"])).withColumn("own", F.expr("substring(path, instr(path, '#') + 1)"))
    invalid = files.select("ord", "own").join(parsed.select("ord", "own"), ["ord", "own"], "left_anti")
    missing = index.missing_fields(parsed, extra=True).withColumn("ord", F.substring_index("path", "#", 1)).withColumn("own", F.expr("substring(path, instr(path, '#') + 1)"))
    targets = current.select(T.page_key(F.col("path")).alias("to_path")).unionByName(ops.select(T.page_key(F.col("path")).alias("to_path"))).distinct()
    ends = parsed.select("ord", "own", F.explode("links").alias("to_path")).join(targets, "to_path", "left_anti")
    kind = dict(ops.dtypes)["ord"]
    more = [
        invalid.select("ord", F.col("own").alias("path"), F.lit("invalid_page").alias("code")),
        missing.select(F.col("ord").cast(kind).alias("ord"), F.col("own").alias("path"), F.lit("missing_field").alias("code")).distinct(),
        ends.select("ord", F.col("own").alias("path"), F.lit("dangling_link").alias("code")).distinct(),
    ]
    return reduce(DataFrame.unionByName, [direct, *more])


def sanitize_plan(ops: DataFrame, current: DataFrame) -> DataFrame:
    """Operations with links to pages that neither exist nor are planned taken out of their
    content, and what was removed noted behind the reason. Content that does not parse stays."""
    valid = current.select(T.page_key(F.col("path")).alias("key")).unionByName(ops.select(T.page_key(F.col("path")).alias("key"))).distinct()
    parsed = P.parse_pages(ops.select(F.concat_ws("#", "ord", "path").alias("path"), "content"))
    clean = P.strip_dangling(parsed, valid).where(F.size("removed") > 0).select(F.substring_index("path", "#", 1).cast(dict(ops.dtypes)["ord"]).alias("ord"), F.col("content").alias("clean"), "removed")
    joined = ops.join(clean, "ord", "left")
    note = F.concat(F.lit("dangling links removed: "), F.array_join("removed", ", "))
    reason = F.when(F.col("removed").isNull(), F.col("reason")).otherwise(F.concat_ws("; ", F.nullif(F.trim(F.coalesce("reason", F.lit(""))), F.lit("")), note))
    return joined.select(*[F.coalesce("clean", "content").alias(c) if c == "content" else reason.alias(c) if c == "reason" else F.col(c) for c in ops.columns])


def apply_plan(ops: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages after, receipt): all operations or, where a check fails, none.

    The verdict is one row that is joined, so the plan stays one Spark job.
    """
    verdict = plan_checks(ops, current).agg((F.count(F.lit(1)) == 0).alias("ok"))
    accepted = ops.crossJoin(F.broadcast(verdict)).where("ok").select(T.vault_path(F.col("path")).alias("path"), "action", F.col("content").alias("after"))
    receipt = accepted.join(current.select("path", F.col("content").alias("before")), "path", "left")
    receipt = receipt.select("path", "action", "before", F.sha2("after", 256).alias("after_hash"))
    kept = current.select("path", "content").join(accepted.select("path"), "path", "left_anti")
    return with_hash(kept.unionByName(accepted.select("path", F.col("after").alias("content")))), receipt


def rollback_conflicts(receipt: DataFrame, current: DataFrame) -> DataFrame:
    """path, code: pages of a receipt that are gone or have changed since."""
    joined = receipt.join(current.select("path", "hash"), "path", "left")
    code = F.when(F.col("hash").isNull(), "missing").when(F.col("hash") != F.col("after_hash"), "changed")
    return joined.select("path", code.alias("code")).where("code IS NOT NULL")


def rollback(receipt: DataFrame, current: DataFrame) -> DataFrame:
    """Pages with a receipt undone; unchanged if any page conflicts."""
    clean = rollback_conflicts(receipt, current).agg((F.count(F.lit(1)) == 0).alias("ok"))
    undo = receipt.crossJoin(F.broadcast(clean)).where("ok").select("path", "before", "action")
    kept = current.select("path", "content").join(undo.select("path"), "path", "left_anti")
    restored = undo.where("action = 'update'").select("path", F.col("before").alias("content"))
    return with_hash(kept.unionByName(restored))


def receipt_chain(receipts: DataFrame, current: DataFrame) -> DataFrame:
    """path, receipt_id, code: changes that cannot be undone, newest receipt first.

    Receipts are (receipt_id, ord, path, before, after_hash), `current` (path, hash). Undoing
    the newest change of a path needs its content to be what the change left; each older one
    needs the before-image of the newer. Where one fails, the content stays what it was, so
    an older change is judged against that: `missing` where the path is gone, else `changed`.
    """
    rows = receipts.join(current.select("path", F.col("hash").alias("now")), "path", "left")
    # The state a change meets: what the last change that matched restored, else the current content.
    lists = rows.groupBy("path", "now").agg(F.array_sort(F.collect_list(F.struct((-F.col("ord")).alias("k"), "receipt_id", "after_hash", F.sha2("before", 256).alias("before_hash")))).alias("changes"))
    start = F.struct(F.col("now").alias("state"), F.array().cast("array<struct<receipt_id:string,code:string>>").alias("found"))
    step = lambda acc, c: F.when(acc["state"].isNull(), _step(acc, c, "missing")).when(acc["state"] != c["after_hash"], _step(acc, c, "changed")).otherwise(F.struct(c["before_hash"].alias("state"), acc["found"].alias("found")))
    found = lists.select("path", F.aggregate("changes", start, step)["found"].alias("found"))
    return found.select("path", F.explode("found").alias("x")).select("path", "x.receipt_id", "x.code")


def _step(acc, change, code: str):
    more = F.array(F.struct(change["receipt_id"].cast("string").alias("receipt_id"), F.lit(code).alias("code")))
    return F.struct(acc["state"].alias("state"), F.concat(acc["found"], more).alias("found"))


def deletion_blockers(sources: DataFrame, attempts: DataFrame, receipts: DataFrame, changes: DataFrame, pages: DataFrame) -> DataFrame:
    """source_id, path, code: why the data of sources cannot be deleted.

    sources (source_id, status), attempts (source_id, operation_id, status), receipts
    (operation_id, status, n_sources), changes (operation_id, ord, path, before, after_hash)
    and current pages (path, content, links). Codes: parsing, missing_receipt, shared_batch,
    missing and changed (the chain), referenced (another page links to one that would go).
    """
    none = F.lit(None).cast("string").alias("path")
    parsing = sources.where("status = 'parsing'").select("source_id", none, F.lit("parsing").alias("code"))
    done = attempts.where("status = 'ingested' AND operation_id IS NOT NULL").select("source_id", "operation_id").distinct().join(receipts.withColumnRenamed("status", "receipt_status"), "operation_id", "left")
    lost = done.where("receipt_status IS NULL").select("source_id", none, F.lit("missing_receipt").alias("code"))
    live = done.where("receipt_status <> 'rolled_back'")
    shared = live.where("n_sources <> 1").select("source_id", none, F.lit("shared_batch").alias("code"))
    own = live.where("n_sources = 1").select("source_id", "operation_id").join(changes, "operation_id")
    chain = receipt_chain(own.withColumnRenamed("operation_id", "receipt_id"), with_hash(pages)).join(own.select(F.col("operation_id").alias("receipt_id"), "source_id").distinct(), "receipt_id").select("source_id", "path", "code")
    sound = own.join(chain.select("source_id").distinct(), "source_id", "left_anti")
    final = sound.groupBy("source_id", "path").agg(F.min_by(F.struct("before"), "ord").alias("first"))
    gone = final.where("first.before IS NULL").select("source_id", T.page_key(F.col("path")).alias("target"))
    ends = pages.select("path", F.posexplode("links").alias("ordinal", "target"))
    referenced = ends.join(gone, "target").join(final.select("source_id", "path"), ["source_id", "path"], "left_anti").groupBy("source_id", "path").agg(F.min("ordinal").alias("ordinal"))
    return reduce(DataFrame.unionByName, [parsing, lost, shared, chain, referenced.select("source_id", "path", F.lit("referenced").alias("code"))])


def edits(requests: DataFrame, staged: DataFrame) -> DataFrame:
    """ord, path, content, code: staged pages (path, content, hash) with one exact replacement
    each (ord, path, base_hash, old_text, new_text). The old text must stand there once."""
    joined = requests.join(staged.select("path", F.col("content").alias("before"), "hash"), "path", "left")
    n = T.occurrences(F.col("before"), F.col("old_text"))
    code = (
        F.when(F.col("before").isNull(), "missing_page").when(F.col("hash") != F.col("base_hash"), "stale_hash").when(F.coalesce("old_text", F.lit("")) == "", "empty_old_text")
        .when(n == 0, "not_found").when(n > 1, "not_unique")
    )
    return joined.select("ord", "path", F.when(code.isNull(), F.replace("before", F.col("old_text"), F.coalesce("new_text", F.lit("")))).alias("content"), code.alias("code"))


def line_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, added, removed: lines behind the common start and before the common end of two
    versions (path, content); a missing version is empty."""
    a, b = before.select("path", F.split("content", "\n").alias("a")), after.select("path", F.split("content", "\n").alias("b"))
    none = F.array().cast("array<string>")
    both = a.join(b, "path", "full").select("path", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))

    def common(x, y):
        pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct((s["n"] + F.when(s["on"] & p["x"].eqNullSafe(p["y"]), 1).otherwise(0)).alias("n"), (s["on"] & p["x"].eqNullSafe(p["y"])).alias("on")))["n"]

    both = both.withColumn("head", common(F.col("a"), F.col("b")))
    rest = lambda c: F.reverse(F.slice(c, F.col("head") + 1, F.greatest(F.size(c) - F.col("head"), F.lit(0))))
    both = both.withColumn("tail", common(rest("a"), rest("b")))
    count = lambda c: F.size(c) - F.col("head") - F.col("tail")
    return both.select("path", count("b").alias("added"), count("a").alias("removed"))


def overlay(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged pages replace existing ones of the same path."""
    return existing.join(staged.select("path"), "path", "left_anti").unionByName(staged)
