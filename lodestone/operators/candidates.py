"""Candidates of knowledge pages: unique ids, drafts, and what is wrong with drafts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from lodestone.functions import text as T
from lodestone.operators.ranking import numbered
from lodestone.storage import stored

#: Places of a request that are looked up together.
BLOCK = 1024


def unique_ids(candidates: DataFrame) -> DataFrame:
    """run_id, ord, id: each candidate's id within its run, by what it asks for (`wanted`, or
    `type` and its number in the run where that is blank) in the order of `ord`,
    then, where two are equal in it, of `wanted` and `type`.

    An id that a candidate before has becomes id-2, id-3 and so on, the first that is free;
    ids made in this way are taken, too. So "a", "a-2", "a" become "a", "a-2", "a-3".

    Those who ask for the same id, a request, get its names in turn, which numbers alone tell.
    Two requests have at most one name in common: that of the one which is the other's text with
    a number from 2 behind it ("a" and "a-2"). The longer one's first row has it unless the
    other got there before. When the other gets there is told by how many of its rows stand
    before that row and by how many smaller numbers it had to skip, so a request's skipped
    numbers follow from one row for each longer request, and are told once for each request,
    those first that are no other's text with a number, then by level. Rows meet them last.
    """
    rows = numbered(candidates.select("run_id", "ord", "wanted", "type"), ["run_id"], ["ord", "wanted", "type"], "place")
    base = F.coalesce(F.nullif(F.trim("wanted"), F.lit("")), F.concat(F.coalesce("type", F.lit("")), F.lit("-"), F.col("place").cast("string")))
    rows = stored(rows.select("run_id", "ord", "place", base.alias("base")))
    bases = rows.groupBy("run_id", "base").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    part = lambda i: F.regexp_extract("base", r"^(.*)-([1-9][0-9]{0,17})$", i)
    longer = bases.where((part(2) != "") & (part(2) != "1")).select("run_id", F.col("base").alias("longer"), part(1).alias("base"), part(2).cast("long").alias("number"), "place")
    longer = stored(longer.join(bases.select("run_id", "base"), ["run_id", "base"], "left_semi"))
    # The first row of a longer request goes along as a mark, of which the count of rows before it is asked.
    every = rows.withColumn("row", F.lit(True)).unionByName(longer.select("run_id", F.lit(None).alias("ord"), "place", "base", F.lit(False).alias("row")))
    every = stored(numbered(every, ["run_id", "base"], ["place"], "k", counted="row"))
    marks = every.where("NOT row").select("run_id", "base", "place", F.col("k").alias("before")).join(longer, ["run_id", "base", "place"])
    # The i-th skipped number (from 0) shifts the rows from place number - i on.
    shifts = _skipped(marks).select("run_id", "base", F.posexplode("numbers").alias("i", "number"))
    shifts = shifts.groupBy("run_id", "base", (F.col("number") - F.col("i")).alias("k")).agg((F.max("i") + 1).alias("shift"))
    shifts = shifts.join(bases.select("run_id", "base", "n"), ["run_id", "base"]).where("k <= n")
    # Rows look shifts up in blocks of places, each with what holds before it, so that no list is long.
    lists = shifts.groupBy("run_id", "base", "n", F.floor(F.col("k") / BLOCK).alias("at")).agg(F.array_sort(F.collect_list(F.struct("k", "shift"))).alias("steps"), F.max("shift").alias("top"))
    down = Window.partitionBy("run_id", "base").orderBy("at")
    until = F.coalesce(F.lead("at").over(down) - 1, F.floor(F.col("n") / BLOCK))
    lists = lists.withColumns({"below": F.coalesce(F.lag("top").over(down), F.lit(0)), "until": until}).select("*", F.explode(F.sequence("at", "until")).alias("block"))
    here = F.col("block") == F.col("at")
    lists = stored(lists.select("run_id", "base", "block", F.when(here, F.col("steps")).alias("steps"), F.when(here, F.col("below")).otherwise(F.col("top")).alias("below")))
    lists = F.broadcast(lists) if lists.count() <= 100_000 else lists
    found = every.where("row").withColumn("block", F.floor(F.col("k") / BLOCK)).join(lists, ["run_id", "base", "block"], "left")
    shift = F.coalesce(F.try_element_at(F.filter("steps", lambda s: s["k"] <= F.col("k")), F.lit(-1))["shift"], "below", F.lit(0))
    number = F.col("k") + shift
    return found.select("run_id", "ord", F.when(number == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), number.cast("string"))).alias("id"))


def _skipped(marks: DataFrame) -> DataFrame:
    """run_id, base, numbers: the numbers that a request skips, by marks (run_id, base, longer,
    number, before): `before` rows of the request stand before the first of `longer`, its text
    with the number."""
    families = stored(marks.groupBy("run_id", "base").agg(F.array_sort(F.collect_list(F.struct("number", "before", "longer"))).alias("longer")))
    level = families.join(marks.select("run_id", F.col("longer").alias("base")), ["run_id", "base"], "left_anti").withColumn("taken", F.lit(False))
    reached = F.pandas_udf(_reached, ArrayType(BooleanType()))
    none, first = F.array().cast("array<bigint>"), F.array(F.lit(1).cast("long"))
    found = []
    # As many levels as numbers stand behind a request's text.
    while True:
        judged = stored(level.withColumn("reached", reached("longer.number", "longer.before", "taken")))
        skipped = F.transform(F.filter(F.arrays_zip("longer", "reached"), lambda x: ~x["reached"]), lambda x: x["longer"]["number"])
        found.append(judged.select("run_id", "base", F.concat(F.when(F.col("taken"), first).otherwise(none), skipped).alias("numbers")))
        below = judged.select("run_id", F.explode(F.arrays_zip("longer", "reached")).alias("x")).select("run_id", F.col("x.longer.longer").alias("base"), F.col("x.reached").alias("taken"))
        found.append(below.where("taken").join(families, ["run_id", "base"], "left_anti").select("run_id", "base", first.alias("numbers")))
        level = below.join(families, ["run_id", "base"]).select("run_id", "base", "longer", "taken")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _reached(numbers: pd.Series, before: pd.Series, taken: pd.Series) -> pd.Series:
    """Whether a request gets to each number before the longer request with that number does;
    the first name of those in `taken` is gone."""
    out = []
    for each, rows, skips in zip(numbers, before, taken.astype(int), strict=True):
        got = []
        for number, n in zip(each, rows, strict=True):
            got.append(bool(number - skips <= n))
            skips += not got[-1]
        out.append(got)
    return pd.Series(out, dtype=object)


def marked_drafts(texts: DataFrame, mark: str = "llm-wiki") -> DataFrame:
    """batch_id, candidate_id, place (from 1), content of the drafts in texts (batch_id, text):
    what stands between `<!-- mark:draft=ID -->` and the next `<!-- mark:end-draft -->`."""
    head, end = rf"<!--\s*{mark}:draft=([^>]+?)\s*-->", rf"<!--\s*{mark}:end-draft\s*-->"
    # A text is gone through once; the parts of a draft are told from it alone.
    rows = texts.select("batch_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"{head}[\s\S]*?{end}"), F.lit(0))).alias("at", "draft"))
    start, n = F.length(F.regexp_extract("draft", f"^{head}", 0)), F.length("draft")
    content = F.substring("draft", start + 1, n - start - F.length(F.regexp_extract("draft", rf"{end}\z", 0)))
    return rows.select("batch_id", T.trimmed(F.regexp_extract("draft", f"^{head}", 1)).alias("candidate_id"), (F.col("at") + 1).alias("place"), F.btrim(content, F.lit(T.SPACE_CHARS)).alias("content"))


def draft_status(drafts: DataFrame, expected: DataFrame) -> DataFrame:
    """batch_id, candidate_id, status, content: every candidate that is expected in a batch
    (batch_id, candidate_id) or has a draft there. Status is ok, missing, repeated or
    unexpected; content is there where it is ok."""
    found = drafts.groupBy("batch_id", "candidate_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("content", "place").alias("content"))
    asked = expected.select("batch_id", "candidate_id").distinct().withColumn("asked", F.lit(True))
    joined = asked.join(found, ["batch_id", "candidate_id"], "full")
    status = F.when(F.col("asked").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("ok")
    return joined.withColumn("status", status).select("batch_id", "candidate_id", "status", F.when(F.col("status") == "ok", F.col("content")).alias("content"))


#: Fields that a draft must have, and those that must be lists.
REQUIRED = ["schema_version", "type", "title", "tldr", "status", "created", "updated", "tags", "related"]
LISTS, MORE_LISTS = ["tags", "related"], {"synthesis": ["sources", "conflicts"]}


def draft_issues(drafts: DataFrame) -> DataFrame:
    """batch_id, candidate_id, code, detail of drafts (batch_id, candidate_id, type, fields,
    body; fields as read from front matter, null where it doesn't parse): empty_page,
    invalid_page, wrong_type, missing_field, not_a_list, empty_body."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    is_list = lambda name: F.coalesce(field(name)["list"], F.lit(False))
    issue = lambda code, when, detail=None: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(detail).cast("string").alias("detail")))
    empty = T.blank(F.coalesce("content", F.lit("")))
    bad = F.col("fields").isNull()
    absent = lambda name: ~F.map_contains_key("fields", name) | F.coalesce(~is_list(name) & (F.array_join(field(name)["items"], "") == ""), F.lit(False))
    kind = F.when(field("type").isNotNull() & ~is_list("type"), field("type")["items"][0])
    rules: list[Column] = [issue("wrong_type", ~kind.eqNullSafe(F.col("type")))]
    rules += [issue("missing_field", absent(name), name) for name in REQUIRED]
    rules += [issue("not_a_list", ~is_list(name), name) for name in LISTS]
    rules += [issue("not_a_list", (F.col("type") == kind_) & ~is_list(name), name) for kind_, names in MORE_LISTS.items() for name in names]
    rules.append(issue("empty_body", T.blank(F.regexp_replace("body", r"^((?:[\s\S]*?\n)?)#[ \t]+[^\n]*", "$1"))))
    found = F.when(empty, F.array(issue("empty_page", F.lit(True)))).when(bad, F.array(issue("invalid_page", F.lit(True)))).otherwise(F.array_compact(F.array(*rules)))
    return drafts.select("batch_id", "candidate_id", F.explode(found).alias("i")).select("batch_id", "candidate_id", "i.*")
