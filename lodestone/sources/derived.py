"""Wiki pages and other inputs derived from the driver's tables.

The SQL is one template for Spark and DuckDB; only the names of a few list functions
differ, so both engines see the same pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {"list": "array", "gather": "sort_array(collect_set({0}))", "join": "concat({0}, {1})", "none": "cast(array() as array<string>)", "render": "array_join(transform({0}, x -> concat('[[', x, '|see]]')), ' ')",
          "tags": "array_join(transform({0}, x -> concat(chr(34), x, chr(34))), ', ')", "aliases": "nullif(array_join(transform({0}, x -> concat(chr(10), '  - ', x)), ''), '')"}
_DUCK = {"list": "list_value", "gather": "list_sort(list(DISTINCT {0}))", "join": "list_concat({0}, {1})", "none": "CAST([] AS VARCHAR[])", "render": "list_aggregate(list_transform({0}, lambda x: '[[' || x || '|see]]'), 'string_agg', ' ')",
         "tags": "list_aggregate(list_transform({0}, lambda x: chr(34) || x || chr(34)), 'string_agg', ', ')", "aliases": "list_aggregate(list_transform({0}, lambda x: chr(10) || '  - ' || x), 'string_agg', '')"}

PAGES = """
parts AS (
    SELECT l_orderkey, {parts} AS parts FROM lineitem GROUP BY l_orderkey
), raw AS (
    SELECT 'wiki/concepts/region-' || CAST(r_regionkey AS STRING) AS path, 'concept' AS type, r_name AS title, {none} AS tags, {none} AS links, CAST(NULL AS STRING) AS text FROM region
    UNION ALL SELECT 'wiki/entities/nation-' || CAST(n_nationkey AS STRING), 'entity', n_name, {none}, {list}('wiki/concepts/region-' || CAST(n_regionkey AS STRING)), NULL FROM nation
    UNION ALL SELECT 'wiki/concepts/nation-' || CAST(n_nationkey AS STRING), 'concept', n_name, {none}, {none}, NULL FROM nation WHERE n_nationkey % 10 = 0
    UNION ALL SELECT 'wiki/entities/supplier-' || CAST(s_suppkey AS STRING), 'entity', s_name, {none}, {list}('wiki/entities/nation-' || CAST(s_nationkey AS STRING)), NULL FROM supplier
    UNION ALL SELECT 'wiki/entities/customer-' || CAST(c_custkey AS STRING), 'entity', c_name, {list}(c_mktsegment), {list}('wiki/entities/nation-' || CAST(c_nationkey AS STRING)), NULL FROM customer
    UNION ALL SELECT 'wiki/concepts/part-' || CAST(p_partkey AS STRING), 'concept', p_name, {list}(p_brand), {none}, NULL FROM part
    UNION ALL SELECT 'wiki/outputs/order-' || CAST(o_orderkey AS STRING), 'output', 'Order ' || CAST(o_orderkey AS STRING), {list}(o_orderpriority), {order_links}, NULL
        FROM orders LEFT JOIN parts ON o_orderkey = l_orderkey
    UNION ALL SELECT 'wiki/sources/doc-' || CAST(doc_id AS STRING), 'source', substring(text, 1, 60), {list}(lang), {list}('wiki/entities/customer-' || CAST(doc_id * 3 AS STRING)), text FROM documents
), wiki AS (
    SELECT path, type, title, tags, links, coalesce(text, 'This page is about ' || title || '.') AS body,
        substring(coalesce(text, 'This page is about ' || title || '.'), 1, 120) AS tldr,
        coalesce(text, 'This page is about ' || title || '.') || ' ' || coalesce({rendered}, '') AS content,
        CASE WHEN type = 'source' THEN 'raw/articles/' || substring(path, 14) || '.md' END AS raw_path,
        CASE WHEN path LIKE 'wiki/entities/nation-%' THEN {list}('The land of ' || title) ELSE {none} END AS aliases,
        CASE WHEN path LIKE 'wiki/concepts/part-%0' THEN '' ELSE 'draft' END AS status
    FROM raw
), files AS (
    SELECT path || '.md' AS path, '---' || chr(10) || 'schema_version: 1' || chr(10) || 'type: ' || type || chr(10) || 'title: ' || {title} || chr(10) || 'tldr: ' || {tldr} || chr(10)
        || 'status: ' || chr(34) || status || chr(34) || chr(10) || 'created: 2024-01-01' || chr(10) || 'updated: 2024-01-02' || chr(10)
        || 'tags: [' || coalesce({tag_list}, '') || ']' || chr(10) || 'related: []' || chr(10) || 'aliases:' || coalesce({alias_list}, ' []') || chr(10)
        || CASE type WHEN 'source' THEN 'source_type: article' || chr(10) || 'author: ' || chr(34) || chr(34) || chr(10) || 'url: ' || chr(34) || chr(34) || chr(10) || 'raw_path: '
            || CASE WHEN path LIKE '%9' THEN chr(34) || chr(34) ELSE chr(34) || '[[' || raw_path || ']]' || chr(34) END || chr(10) || 'raw_hash: ' || chr(34) || chr(34) || chr(10)
            WHEN 'output' THEN 'output_type: tldr' || chr(10) ELSE '' END
        || '---' || chr(10) || chr(10) || content AS content
    FROM wiki
)
"""


def _quoted(x: str) -> str:
    return f"chr(34) || replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n') || chr(34)"


def pages_sql(names: dict[str, str]) -> str:
    part = "'wiki/concepts/part-' || CAST(l_partkey AS STRING)"
    customer = f"{names['list']}('wiki/entities/customer-' || CAST(o_custkey AS STRING))"
    return PAGES.format(
        parts=names["gather"].format(part), none=names["none"], list=names["list"],
        order_links=names["join"].format(customer, f"coalesce(parts, {names['none']})"), rendered=names["render"].format("links"),
        title=_quoted("title"), tldr=_quoted("tldr"), tag_list=names["tags"].format("tags"), alias_list=names["aliases"].format("aliases"),
    )


DUCK_PAGES = "WITH " + pages_sql(_DUCK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    names = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "documents"]
    query = "WITH " + pages_sql(_SPARK) + f" SELECT * FROM {what}"
    for name in names:
        query = query.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"FROM {name}\n", f"FROM {{{name}}}\n")
    return spark.sql(query, **{name: table(spark, sf_dir, name) for name in names})


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, type, title, tags, links, body, tldr, content, raw_path, aliases, status."""
    return _derived(spark, sf_dir, "wiki")


def wiki_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: the same pages as files with front matter. Concepts of parts whose key
    ends in 0 have an empty status, documents whose id ends in 9 no raw path."""
    return _derived(spark, sf_dir, "files")


def as_markdown(docs: DataFrame, every: int = 5) -> DataFrame:
    """Plain documents with every fifth line made a heading (but the first of every third
    document) and every seventh a fence."""
    plain = F.col("doc_id") % 3 == 0
    line = lambda x, i: F.when((i % every == 0) & ~(plain & (i == 0)), F.concat(F.lit("## "), x)).when(i % 7 == 3, F.lit("```")).otherwise(x)
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def segments_of(conversations: DataFrame) -> DataFrame:
    """Conversations as timed segments: a turn every four seconds, of one and a half; those
    behind every third turn come four seconds later still."""
    start = F.col("turn") * 4000 + F.floor((F.col("turn") + 1) / 3) * 4000
    return conversations.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), start.alias("start_ms"), (start + 1500).alias("end_ms"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


#: What the event types of the events table stand for as phases of a run: percent at the
#: start of each and the percent it spans.
EVENT_PHASES = {"click": (0, 10), "view": (10, 70), "purchase": (80, 15), "signup": (95, 5)}


def progress_events(events: DataFrame) -> DataFrame:
    """The events table as progress: source_id, seq, phase, completed, total."""
    done = F.get_json_object("props", "$.k").try_cast("double")
    return events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("phase"), done.alias("completed"), F.lit(100.0).alias("total"))
