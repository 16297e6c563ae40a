"""Links, backlinks, navigation cards and lint rules over a table of wiki pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.ranking import numbered
from lodestone.operators.structure import concept_identity
from lodestone.storage import stored

#: Fixed value: the heading of a page's related pages.
RELATED = "关联条目"
TYPES = ["source", "entity", "concept", "synthesis", "output"]


def page_links(pages: DataFrame) -> DataFrame:
    """from_path, to_path, ordinal: the links of each page, in order. Pages with a `links`
    column (body and related links) have theirs there, others in their content."""
    found = F.col("links") if "links" in pages.columns else T.wiki_links(F.col("content"))
    return pages.select(T.page_key(F.col("path")).alias("from_path"), F.posexplode(found).alias("ordinal", "to_path"))


def resolved_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(pages.select(F.col("path").alias("to_path")), "to_path", "left_semi")


def dangling_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(pages.select(F.col("path").alias("to_path")), "to_path", "left_anti")


def backlinks(links: DataFrame, pages: DataFrame) -> DataFrame:
    """path, from_path: one row per page and page that links to it, no self-links.

    Rows rather than lists: a hub that most pages link to stays spread over tasks.
    """
    found = resolved_links(links, pages).where("from_path <> to_path")
    return found.select(F.col("to_path").alias("path"), "from_path").distinct()


def backlink_counts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """path, n for every page; counts are combined before the shuffle."""
    found = links.where("from_path <> to_path").select("from_path", "to_path").distinct()
    counts = found.groupBy(F.col("to_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return pages.select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def orphans(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages without a link in or out; a link to itself counts."""
    ends = links.select(F.explode(F.array("from_path", "to_path")).alias("key")).distinct()
    return pages.withColumn("key", T.page_key(F.col("path"))).join(ends, "key", "left_anti").select("path")


def nav_cards(pages: DataFrame) -> DataFrame:
    """path, hash, type, title, aliases, tags, tldr, headings, n_outgoing, n_backlinks, tokens.

    Lists are cut before they are sorted; tokens are those of the card as JSON. Link lists
    stay rows (`page_links`, `backlinks`), a card has their counts.
    """
    links = page_links(pages)
    cut = lambda c, n, width: F.array_sort(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), lambda x: F.substring(x, 1, width)))
    out = links.where("from_path <> to_path").select("from_path", "to_path").distinct().groupBy(F.col("from_path").alias("path")).agg(F.count(F.lit(1)).alias("n_outgoing"))
    title = F.substring("title", 1, 240)
    cards = pages.select(
        "path", F.sha2("content", 256).alias("hash"), "type", title.alias("title"), cut(F.col("aliases"), 20, 160).alias("aliases"), cut(F.col("tags"), 30, 80).alias("tags"),
        T.compact_tldr(F.when(F.col("tldr") == "", F.col("title")).otherwise(F.col("tldr"))).alias("tldr"), page_headings(F.col("body"), F.col("title")).alias("headings"),
    )
    cards = cards.join(out, "path", "left").join(backlink_counts(links, pages).withColumnRenamed("n", "n_backlinks"), "path")
    cards = cards.withColumn("n_outgoing", F.coalesce("n_outgoing", F.lit(0).cast("long")))
    card = F.to_json(F.struct("path", "hash", "type", "title", "aliases", "tags", "tldr", "headings", F.col("n_outgoing").alias("outgoingCount"), F.col("n_backlinks").alias("backlinkCount")))
    return cards.withColumn("card", card).withColumn("tokens", T.token_estimate(F.col("card")))


def page_headings(body: Column, title: Column, most: int = 80) -> Column:
    """Headings of a body but its title and the heading of related pages, the first `most`."""
    found = F.regexp_extract_all(body, F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1))
    clean = F.transform(found, lambda h: F.substring(F.trim(F.regexp_replace(h, r"\s+#+\s*$", "")), 1, 200))
    return F.slice(F.filter(clean, lambda h: (h != "") & (h != F.coalesce(title, F.lit(""))) & (h != RELATED)), 1, most)


def type_counts(pages: DataFrame) -> DataFrame:
    """Pages per type, zero-filled."""
    every = pages.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    counts = pages.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def tag_counts(pages: DataFrame) -> DataFrame:
    """Pages per tag; a page's first thirty tags count."""
    return pages.select(F.explode(F.slice("tags", 1, 30)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def revision(pages: DataFrame) -> DataFrame:
    """revision: one hash of paths, contents and links, in order. Backlinks follow from the
    links, so they need not go in. Pages are hashed in buckets by path, so that no task
    gathers all of them; an empty table has the hash of nothing."""
    none = F.array().cast("array<string>")
    outgoing = F.array_join(F.array_sort(F.array_distinct(F.filter(F.coalesce("links", none), lambda x: x != F.col("path")))), ",")
    rows = pages.select(F.substring(F.sha2("path", 256), 1, 3).alias("bucket"), "path", F.sha2(F.concat_ws("|", "path", F.sha2("content", 256), outgoing), 256).alias("h"))
    joined = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "")
    buckets = rows.groupBy("bucket").agg(F.sha2(joined("path"), 256).alias("h"))  # at most 4,096 rows
    return buckets.agg(F.sha2(joined("bucket"), 256).alias("revision"))


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """fingerprint: one hash of (path, mtime, size) of all files, in order of path, bucketed
    like `revision`."""
    rows = files.select(F.substring(F.sha2("path", 256), 1, 3).alias("bucket"), "path", F.concat_ws(":", "path", "mtime", "size").alias("h"))
    joined = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n")
    buckets = rows.groupBy("bucket").agg(F.sha2(joined("path"), 256).alias("h"))
    return buckets.agg(F.sha2(joined("bucket"), 256).alias("fingerprint"))


def budget_page(cards: DataFrame, group: str = "type", offset: int = 0, limit: int = 50, budget: int = 8000) -> DataFrame:
    """One page of cards for each group from an offset: by path, within a token budget, one
    card at least and `limit` (1 to 100) at most. next_offset is null on the last page.

    The limit comes first: only `limit` rows of a group reach the running sum.
    """
    if offset < 0:
        raise ValueError("an offset is not negative")
    limit = max(1, min(100, limit))
    order = Window.partitionBy(group).orderBy("path")
    total = cards.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    first = cards.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= offset + limit).where(F.col("rank") > offset)
    spent = first.withColumn("spent", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = spent.where((F.col("spent") <= budget) | (F.col("rank") == offset + 1))
    ends = taken.groupBy(group).agg(F.max("rank").alias("end")).join(total, group).select(group, F.when(F.col("end") < F.col("total"), F.col("end")).alias("next_offset"))
    return taken.join(ends, group).select(group, "path", "rank", "spent", "next_offset")


def root_view(cards: DataFrame, budget: int = 12_000, each: int = 5) -> DataFrame:
    """mode, path, type, tokens: all cards where their JSON fits the budget ("complete"),
    else the first few of each type ("layered"). What all cards take is estimated from their
    characters, so they need not meet in one place: brackets and commas are added. Cards are
    made once; of what they take, a row of numbers each is kept."""
    wide = F.length(F.regexp_replace("card", r"[\x00-\x7F]", ""))
    held = stored(cards.select("path", "type", "tokens", wide.alias("wide"), (F.length("card") - wide).alias("narrow")))
    sizes = held.agg(F.coalesce(F.sum("wide"), F.lit(0)).alias("wide"), F.coalesce(F.sum("narrow"), F.lit(0)).alias("narrow"), F.count(F.lit(1)).alias("n"))
    total = F.col("wide") + F.ceil((F.col("narrow") + F.greatest(F.col("n") - 1, F.lit(0)) + 2) / 4)
    mode = sizes.select(F.when(total <= budget, "complete").otherwise("layered").alias("mode"), total.cast("long").alias("complete_tokens")).first()
    # All cards are few where they fit. Of the others, a type may hold most, so each task leaves
    # the first of its own before they meet.
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy("path")))
    chosen = ranked if mode.mode == "complete" else ranked.where(F.col("rank") <= each)
    return chosen.select(F.lit(mode.mode).alias("mode"), F.lit(mode.complete_tokens).cast("long").alias("complete_tokens"), "path", "type", "rank", "tokens")


def root_document(cards: DataFrame, pages: DataFrame, budget: int = 12_000, each: int = 5) -> DataFrame:
    """document: the root view as one JSON text with revision, mode, counts of types and tags
    and its cards. The cards fit the budget or are a few of each type, so they fit a row; all
    tags are listed with their counts, as many as the corpus has."""
    view = root_view(cards, budget, each).select("mode", "path").join(cards.select("path", "card"), "path")
    listed = view.groupBy("mode").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "card"))), lambda x: x["card"]).alias("cards"))
    types = type_counts(pages).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("typeCounts"))
    tags = tag_counts(pages).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("tagCounts"))
    rows = listed.crossJoin(F.broadcast(types)).crossJoin(F.broadcast(tags)).crossJoin(F.broadcast(revision(pages)))  # one row each
    head = F.to_json(F.struct("revision", "mode", "typeCounts", "tagCounts"))
    return rows.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"pages":['), F.array_join("cards", ","), F.lit("]}")).alias("document"))


def visible_index(pages: DataFrame, most: int = 180) -> DataFrame:
    """type, position, line: the published list of pages, a line each, by title within the
    type; a type without pages has one empty line."""
    line = F.concat(F.lit("- [["), "path", F.lit("|"), "title", F.lit("]] — "), T.compact_tldr(F.col("tldr"), most))
    rows = numbered(pages.select("type", "title", "path", line.alias("line")), ["type"], ["title", "path"], "position").select("type", F.col("position").cast("int").alias("position"), "line")
    every = pages.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    # Lines meet no type in a join, as all lines of a type would be in one task there.
    absent = every.join(pages.select("type").distinct(), "type", "left_anti").select("type", F.lit(0).alias("position"), F.lit("").alias("line"))
    return rows.where(F.col("type").isin(TYPES)).select("type", "position", F.coalesce("line", F.lit("")).alias("line")).unionByName(absent)


def valid_cards(cards: DataFrame) -> DataFrame:
    """path, code: cards whose fields have no right shape."""
    codes = F.array(
        F.when(~F.coalesce(F.col("path").startswith("wiki/"), F.lit(False)), "path_outside_wiki"), F.when(~F.coalesce(F.col("type").isin(TYPES), F.lit(False)), "unknown_type"),
        F.when(F.col("hash").isNull() | F.col("title").isNull() | F.col("tldr").isNull(), "missing_text"), F.when(F.col("tags").isNull() | F.col("aliases").isNull() | F.col("headings").isNull(), "missing_list"),
    )
    return cards.select("path", F.explode(F.array_compact(codes)).alias("code"))


#: What every page states, and what the types state besides.
REQUIRED = ["schema_version", "type", "title", "tldr", "status", "created", "updated", "tags", "related"]
EXTRA = {"source": ["source_type", "author", "url", "raw_path", "raw_hash"], "synthesis": ["sources", "conflicts"], "output": ["output_type"]}
KNOWLEDGE = ["entity", "concept", "synthesis"]


def _issue(rows: DataFrame, code: str, severity: str, fixable: bool = False) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "path", F.lit(fixable).alias("fixable"))


def identities(pages: DataFrame) -> DataFrame:
    """path, type, identity: the distinct identities of a page, from its title, aliases and
    file name, of two characters or more."""
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.md$", "")
    names = pages.select("path", "type", F.explode(F.array_distinct(F.concat(F.array(F.coalesce("title", F.lit("")), base), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    found = names.select("path", "type", concept_identity(F.col("name")).alias("identity"))
    return found.where(F.length("identity") >= 2).distinct()


def type_conflicts(pages: DataFrame) -> DataFrame:
    """identity, path: pages of knowledge types that share an identity with a page of another
    type. Of identities with the same pages the smallest is reported."""
    known = identities(pages.where(F.col("type").isin(KNOWLEDGE)))
    crossed = known.groupBy("identity").agg(F.min("type").alias("a"), F.max("type").alias("b")).where("a <> b").select("identity")
    rows = known.join(crossed, "identity", "left_semi")
    # A set of pages is told by the sum of its paths' hashes, so it is never gathered.
    marked = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path").cast("decimal(38,0)")).alias("paths"))
    first = marked.groupBy("n", "paths").agg(F.min("identity").alias("identity")).select("identity")
    return rows.join(first, "identity", "left_semi").select("identity", "path")


def missing_fields(pages: DataFrame, extra: bool = False) -> DataFrame:
    """path, field: required fields that are absent or empty; with `extra` also the fields
    of the page's type that are absent. `fields` maps names to texts, lists to their JSON."""
    lacks = F.filter(F.array(*map(F.lit, REQUIRED)), lambda f: ~F.map_contains_key("fields", f) | (F.try_element_at("fields", f) == ""))
    if extra:
        none = F.array().cast("array<string>")
        more = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in EXTRA.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("type")), none)
        lacks = F.concat(lacks, F.filter(more, lambda f: ~F.map_contains_key("fields", f)))
    return pages.select("path", F.explode(lacks).alias("field"))


def missing_raw_files(pages: DataFrame, raw_paths: DataFrame) -> DataFrame:
    """path of source pages whose raw file is neither there as written nor without `.md`."""
    sources = pages.where("type = 'source' AND raw_path <> ''")
    wanted = sources.select("path", T.page_key(F.regexp_replace("raw_path", r"^\[\[|\]\]$", "")).alias("key"))
    there = raw_paths.select(T.page_key(F.col("raw_path")).alias("key")).distinct()
    return wanted.join(there, "key", "left_anti").select("path")


def lint(pages: DataFrame, raw_paths: DataFrame, index_path: str = "wiki/index") -> DataFrame:
    """code, severity, path, fixable: every rule's findings, one row per finding.

    Pages have path, type, title, aliases, fields, links and raw_path; `raw_paths` are the
    other files there are. Keys that repeat are counted by partial aggregation and joined
    back, so a title shared by many pages never gathers its pages in one group.
    """
    # Thin rows, stored for the rules below: reading front matter again costs more.
    pages = stored(pages.select("path", "type", "title", "aliases", "fields", "links", "raw_path"))
    links = page_links(pages)
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    flaw = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    fields = F.filter(F.array(*map(F.lit, REQUIRED)), lambda f: ~F.map_contains_key("fields", f) | (F.try_element_at("fields", f) == ""))
    flaws = F.concat(
        F.array(flaw(~base.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "invalid-filename", "warning"), flaw((F.col("type") == "source") & (F.coalesce("raw_path", F.lit("")) == ""), "missing-raw-path", "error")),
        F.transform(fields, lambda f: F.struct(F.lit("missing-field").alias("code"), F.lit("error").alias("severity"))),
    )
    rows = pages.select("path", F.explode(F.array_compact(flaws)).alias("x")).select("x.code", "x.severity", "path", F.lit(False).alias("fixable"))
    titles = pages.select("path", F.lower(F.trim("title")).alias("key")).where("key <> ''")
    repeated = titles.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    there = pages.select(T.page_key(F.col("path")).alias("path")).unionByName(raw_paths.select(T.page_key(F.col("raw_path")).alias("path")))
    has_index = there.where(F.col("path") == index_path).agg(F.count(F.lit(1)).alias("n"))
    ends = pages.select("path", F.explode("links").alias("to_path"))
    rules = [
        rows,
        _issue(ends.join(there.withColumnRenamed("path", "to_path").distinct(), "to_path", "left_anti"), "dangling-link", "error"),
        _issue(orphans(links, pages), "orphan-page", "warning"),
        _issue(missing_raw_files(pages, there.withColumnRenamed("path", "raw_path")), "missing-raw-file", "warning"),
        _issue(titles.join(repeated, "key", "left_semi"), "duplicate-title", "warning"),
        _issue(type_conflicts(pages), "cross-type-duplicate", "warning"),
        _issue(has_index.where("n = 0").select(F.lit(index_path).alias("path")), "missing-index", "warning", True),
    ]
    return reduce(DataFrame.unionByName, rules)


def lint_counts(issues: DataFrame) -> DataFrame:
    """severity, n: findings per severity, both always there."""
    counts = issues.agg(F.count_if(F.col("severity") == "error").alias("error"), F.count_if(F.col("severity") == "warning").alias("warning"))
    return counts.select(F.expr("stack(2, 'error', error, 'warning', warning) AS (severity, n)"))


#: What the modes of a lint report show.
FRONTMATTER_CODES = ["missing-field", "missing-raw-path", "missing-raw-file"]


def lint_mode(issues: DataFrame, mode: str) -> DataFrame:
    """The findings of a mode: quick (errors), queue (fixable), frontmatter, or all."""
    if mode == "quick":
        return issues.where("severity = 'error'")
    if mode == "queue":
        return issues.where("fixable")
    return issues.where(F.col("code").isin(FRONTMATTER_CODES)) if mode == "frontmatter" else issues
