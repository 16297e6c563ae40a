"""Raw artifacts: assets, placeholders, building, and verification against manifests.

An artifact is a Markdown file with front matter that names its source, parser and hashes. A
manifest's revisions say what each must be. Revisions meet their files in one left join, and
every rule is an expression over the joined row; only files, never their texts, are looked
up again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import structure
from lodestone.operators.ranking import left_spread

#: Ids of assets, the extension of each type, and how placeholders and marks look.
ASSET_ID = "^[a-zA-Z0-9_-]+$"
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/gif": "gif", "image/svg+xml": "svg"}
MARK = "llm-wiki"
PLACEHOLDER = f"{MARK}-asset:([a-zA-Z0-9_-]+)"
PAGE_MARK, BLOCK_MARK = rf"^<!--\s*{MARK}:page=(\d+)(?:\s+source=\w+)?\s*-->$", rf"^<!--\s*{MARK}:block=(b\d{{6}})\s*-->$"
KIND, VERSION = "raw_document", 3


def _clean_root(root: str) -> str:
    return root.rstrip("/")


def asset_table(assets: DataFrame, root: str = "raw") -> DataFrame:
    """source_id, asset_id, mime, size, hash, path, error of assets (source_id, asset_id, mime,
    content). An error is INVALID_ASSET_ID, DUPLICATE_ASSET_ID (each row of the id) or
    UNSUPPORTED_MIME, the first that fits; such a row has no path."""
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    extension = F.try_element_at(kinds, F.lower("mime"))
    repeated = assets.groupBy("source_id", "asset_id").agg((F.count(F.lit(1)) > 1).alias("repeated")).where("repeated")
    rows = assets.select("source_id", "asset_id", "mime", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))
    rows = rows.join(repeated, ["source_id", "asset_id"], "left")
    error = F.when(~F.coalesce(F.col("asset_id").rlike(ASSET_ID), F.lit(False)), "INVALID_ASSET_ID").when(F.col("repeated"), "DUPLICATE_ASSET_ID").when(extension.isNull(), "UNSUPPORTED_MIME")
    path = F.concat(F.lit(f"{_clean_root(root)}/assets/"), F.col("source_id").cast("string"), F.lit("/"), "asset_id", F.lit("."), extension)
    return rows.select("source_id", "asset_id", "mime", "size", "hash", F.when(error.isNull(), path).alias("path"), error.alias("error"))


def asset_totals(assets: DataFrame, most_bytes: int, most_each: int = 8 << 20) -> DataFrame:
    """source_id, n, bytes, error of asset rows (source_id, size): ASSET_INVALID where one is
    empty or larger than `most_each`, ASSET_LIMIT where all together are over `most_bytes`."""
    bad = (F.coalesce("size", F.lit(0)) <= 0) | (F.col("size") > most_each)
    sums = assets.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max(bad).alias("bad"))
    return sums.select("source_id", "n", "bytes", F.when(F.col("bad"), "ASSET_INVALID").when(F.col("bytes") > most_bytes, "ASSET_LIMIT").alias("error"))


def place_assets(texts: DataFrame, assets: DataFrame, root: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(texts, unknown): texts (source_id, markdown) with the relative path of an asset for
    each of its placeholders, and source_id, asset_id of placeholders that name none; a text
    with an unknown one has a null markdown.

    Only ids and their places travel to the assets; a text meets the paths found for it once,
    and those without placeholders do not move. Rows must have distinct source_ids.
    """
    prefix = f"{_clean_root(root)}/"
    ids = F.regexp_extract_all("markdown", F.lit(PLACEHOLDER), F.lit(1))
    asked = texts.select("source_id", F.posexplode(ids).alias("at", "asset_id"))
    relative = F.when(F.col("path").startswith(prefix), F.concat(F.lit("../"), F.substring("path", len(prefix) + 1, 1 << 30))).otherwise(F.col("path"))
    known = assets.where("path IS NOT NULL").select("source_id", "asset_id", relative.alias("to")).dropDuplicates(["source_id", "asset_id"])
    found = asked.join(known, ["source_id", "asset_id"], "left")
    unknown = found.where("to IS NULL").select("source_id", "asset_id").distinct()
    placed = found.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("to", F.lit("")).alias("to")))).alias("found"), F.max(F.col("to").isNull()).alias("lost"))
    has = F.col("markdown").rlike(PLACEHOLDER)
    between = F.split("markdown", PLACEHOLDER, -1)
    filled = F.array_join(F.flatten(F.zip_with(between, F.col("found"), lambda text, p: F.array(text, F.coalesce(p["to"], F.lit(""))))), "")
    done = texts.where(has).join(placed, "source_id").withColumn("markdown", F.when(~F.col("lost"), filled)).select(*texts.columns)
    return texts.where(~F.coalesce(has, F.lit(False))).unionByName(done), unknown


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def build(payloads: DataFrame, assets: DataFrame, root: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(artifacts, unknown): source_id, artifact, content_hash, artifact_hash and n_blocks of
    parsed payloads (source_id, source_kind, source_hash, name, mime, parser_id,
    parser_version, markdown); assets as from `asset_table`. Texts come in their stored form;
    a payload with an unknown placeholder gives no artifact."""
    placed, unknown = place_assets(payloads, assets, root)
    rows = placed.where("markdown IS NOT NULL")
    bodies = structure.normalized(rows.select(F.col("source_id").alias("doc_id"), F.col("markdown").alias("text"))).withColumnRenamed("doc_id", "source_id")
    fields = [("schema_version", F.lit(VERSION).cast("string")), ("kind", F.lit(KIND))]
    fields += [(name, _quoted(F.col(column))) for name, column in (("source_id", "source_id"), ("source_kind", "source_kind"), ("source_hash", "source_hash"), ("content_hash", "content_hash"), ("original_name", "name"), ("original_mime", "mime"), ("parser_id", "parser_id"), ("parser_version", "parser_version"))]
    header = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), value) for name, value in fields))
    joined = rows.drop("markdown").join(bodies, "source_id").withColumn("content_hash", F.sha2("body", 256))
    made = joined.withColumn("artifact", F.concat(F.lit("---\n"), header, F.lit("\n---\n"), "body"))
    return made.select("source_id", "artifact", "content_hash", F.sha2("artifact", 256).alias("artifact_hash")), unknown


def marks(body: Column) -> Column:
    """Marks outside fenced code, in turn: array of (line from 1, page or null, block or null).
    Only lines that are a fence or a mark are folded over."""
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.substring(F.regexp_extract(x, r"^\s*(```+|~~~+)", 1), 1, 1).alias("fence"), T.trimmed(x).alias("x")))
    odd = F.filter(lines, lambda s: (s["fence"] != "") | s["x"].startswith("<!--"))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<line int, x string>>").alias("out"))
    step = lambda acc, s: F.struct(
        F.when(s["fence"] == "", acc["open"]).when(acc["open"] == "", s["fence"]).when(acc["open"] == s["fence"], "").otherwise(acc["open"]).alias("open"),
        F.when((s["fence"] == "") & (acc["open"] == "") & (s["x"].rlike(PAGE_MARK) | s["x"].rlike(BLOCK_MARK)), F.array_append(acc["out"], F.struct(s["line"].alias("line"), s["x"].alias("x")))).otherwise(acc["out"]).alias("out"),
    )
    some = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    return F.transform(F.aggregate(odd, start, step)["out"], lambda s: F.struct(s["line"].alias("line"), some(s["x"], PAGE_MARK).cast("int").alias("page"), some(s["x"], BLOCK_MARK).alias("block")))


def _field(block: Column, name: str) -> Column:
    """A scalar of a raw file's front matter, without its quotes; null where it is absent."""
    line = F.regexp_extract_all(block, F.lit(rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$"), F.lit(1))
    value = F.try_element_at(line, F.lit(1))
    bare = F.regexp_replace(value, r"^([\"'])(.*)\1$", "$2")
    return F.when(value.startswith('"'), F.regexp_replace(bare, r"\\(.)", "$1")).otherwise(bare)


def _in_root(path: Column, root: str) -> Column:
    clean = T.vault_path(path)
    return F.coalesce(clean.startswith(f"{plain_root(root)}/") & ~F.array_contains(F.split(clean, "/"), ".."), F.lit(False))


def plain_root(root: str) -> str:
    return "/".join(p for p in root.replace("\\", "/").split("/") if p)


def verify_revisions(revisions: DataFrame, files: DataFrame, maps: DataFrame, assets: DataFrame, objects: DataFrame, root: str = "raw") -> DataFrame:
    """source_id, revision, code: the first thing that is wrong with each revision, null where
    nothing is.

    revisions: source_id, source_hash, source_kind, revision, schema_version, raw_path,
    artifact_hash, content_hash, parser_id, parser_version, page_count, map_path, map_hash.
    files: path, content of raw files. maps: path, hash, source_id, source_hash, content_hash,
    entries (array of block_id, start_line, end_line). assets: source_id, revision, path, hash
    that a revision names. objects: path, hash of the asset files.

    Version 1 has page marks, version 2 page marks and a source map whose entries are the
    block marks in turn, version 3 neither.
    """
    f = files.select(F.col("path").alias("raw_path"), F.col("content").alias("artifact")).dropDuplicates(["raw_path"])
    m = maps.select(F.col("path").alias("map_path"), F.struct("hash", "source_id", "source_hash", "content_hash", "entries").alias("map")).dropDuplicates(["map_path"])
    clean = T.vault_path(F.col("path"))
    place = clean.startswith(F.concat(F.lit(f"{plain_root(root)}/assets/"), F.col("source_id").cast("string"), F.lit("/"))) & ~F.array_contains(F.split(clean, "/"), "..")
    held = assets.withColumn("clean", clean).withColumn("inside", place).join(objects.select(F.col("path").alias("clean"), F.col("hash").alias("now")), "clean", "left")
    code = F.when(~F.col("inside"), "1 ASSET_OUTSIDE").when(F.col("now").isNull(), "2 ASSET_MISSING").when(F.col("now") != F.col("hash"), "3 ASSET_HASH")
    flawed = held.withColumn("asset_code", code).groupBy("source_id", "revision").agg(F.min("asset_code").alias("asset_code"))

    block = F.regexp_extract("artifact", r"^---\n([\s\S]*?)\n---\n?", 1)
    # Most revisions have no map.
    rows = left_spread(revisions.join(f, "raw_path", "left"), m, "map_path", "source_id").join(flawed, ["source_id", "revision"], "left")
    rows = rows.withColumns({"has_block": F.col("artifact").rlike(r"^---\n([\s\S]*?)\n---\n?") & (block != ""), "block": block, "body": F.regexp_replace("artifact", r"^---\n([\s\S]*?)\n---\n?", "")})
    rows = rows.withColumns({"marks": marks(F.col("body")), "lines": F.split(F.regexp_replace("body", r"\n\z", ""), "\n")})
    pages = F.transform(F.filter("marks", lambda s: s["page"].isNotNull()), lambda s: s["page"])
    blocks = F.transform(F.filter("marks", lambda s: s["block"].isNotNull()), lambda s: s["block"])
    entries = F.transform("map.entries", lambda e: e["block_id"])
    other = lambda name, column: ~F.coalesce(_field(F.col("block"), name) == F.col(column).cast("string"), F.lit(False))
    ordered = (F.size(pages) == F.col("page_count")) & F.forall(F.transform(pages, lambda p, i: p == i + 1), lambda x: x)
    bad_line = F.exists("map.entries", lambda e: (e["start_line"] < 2) | (e["end_line"] < e["start_line"]) | (e["end_line"] > F.size("lines")))
    bad_place = F.exists("map.entries", lambda e: ~F.coalesce(T.trimmed(F.try_element_at("lines", e["start_line"] - 1)) == F.concat(F.lit(f"<!-- {MARK}:block="), e["block_id"], F.lit(" -->")), F.lit(False)))
    two, three, over_one = F.col("schema_version") == 2, F.col("schema_version") >= 3, F.col("schema_version") > 1
    no = lambda c: ~F.coalesce(c, F.lit(False))
    found = (
        F.when(~_in_root(F.col("raw_path"), root), "PATH_OUTSIDE").when(F.col("artifact").isNull(), "FILE_MISSING").when(no(F.sha2("artifact", 256) == F.col("artifact_hash")), "ARTIFACT_HASH")
        .when(~F.col("has_block"), "FRONT_MATTER").when(no(_field(F.col("block"), "kind") == KIND), "KIND").when(other("source_id", "source_id"), "SOURCE_ID").when(other("source_hash", "source_hash"), "SOURCE_HASH")
        .when(other("parser_id", "parser_id"), "PARSER_ID").when(other("parser_version", "parser_version"), "PARSER_VERSION").when(no(F.sha2("body", 256) == F.col("content_hash")), "BODY_HASH").when(other("content_hash", "content_hash"), "CONTENT_HASH")
        .when(over_one & other("schema_version", "schema_version"), "SCHEMA_VERSION").when(over_one & other("source_kind", "source_kind"), "SOURCE_KIND")
        .when(~three & F.col("page_count").isNotNull() & ~ordered, "PAGE_MARKS")
        .when(two & (F.coalesce("map_path", F.lit("")) == ""), "MAP_UNNAMED").when(two & (F.col("map").isNull() | no(F.col("map.hash") == F.col("map_hash"))), "MAP_UNREADABLE")
        .when(two & (no(F.col("map.source_id") == F.col("source_id")) | no(F.col("map.source_hash") == F.col("source_hash")) | no(F.col("map.content_hash") == F.col("content_hash"))), "MAP_SOURCE")
        .when(two & ((F.size(blocks) != F.size(F.array_distinct(blocks))) | (F.size(entries) != F.size(F.array_distinct(entries)))), "MAP_REPEATED")
        .when(two & no(blocks == entries), "MAP_BLOCKS").when(two & F.coalesce(bad_line, F.lit(False)), "MAP_LINES").when(two & F.coalesce(bad_place, F.lit(False)), "MAP_PLACE")
        .when(three & (F.size("marks") > 0), "MARKS_LEFT").when(three & (F.coalesce("map_path", "map_hash", F.lit("")) != ""), "MAP_UNEXPECTED").otherwise(F.substring("asset_code", 3, 40))
    )
    return rows.select("source_id", "revision", found.alias("code"))


def verification(manifests: DataFrame, revisions: DataFrame, judged: DataFrame, files: DataFrame, bad_manifests: DataFrame | None = None, bad_objects: DataFrame | None = None, root: str = "raw") -> DataFrame:
    """subject, ok, issues (code: detail, sorted) for each source, for each raw file that no
    revision claims, and for each manifest that could not be read.

    manifests: source_id, status, current_revision. judged: as from `verify_revisions`.
    bad_manifests: path, code; bad_objects: source_id, code of originals that are gone or
    changed.
    """
    issue = lambda code, detail: F.concat(F.lit(f"{code}: "), detail)
    name = F.col("source_id").cast("string")
    now = revisions.select("source_id", F.col("revision").alias("current_revision"), F.lit(True).alias("there")).distinct()
    none = manifests.join(now, ["source_id", "current_revision"], "left").where("status = 'parsed' AND there IS NULL")
    parts = [
        none.select(name.alias("subject"), F.lit("RAW_REVISION_MISSING").alias("issue")),
        judged.where("code IS NOT NULL").select(name.alias("subject"), issue("RAW_INTEGRITY_FAILED", F.concat(F.lit("revision "), F.col("revision").cast("string"), F.lit(" "), "code")).alias("issue")),
    ]
    if bad_objects is not None:
        parts.append(bad_objects.select(name.alias("subject"), issue("SOURCE_OBJECT_INVALID", F.col("code")).alias("issue")))
    found = reduce(DataFrame.unionByName, parts).groupBy("subject").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    sources = manifests.select(name.alias("subject")).distinct().join(found, "subject", "left")
    claimed = revisions.select(F.col("raw_path").alias("path")).distinct()
    loose = files.where(~F.col("path").startswith(f"{root}/assets/")).select("path").join(claimed, "path", "left_anti")
    extra = [loose.select(F.concat(F.lit("unmanaged:"), "path").alias("subject"), F.array(F.lit("UNMANAGED_RAW_FILE")).alias("issues"))]
    if bad_manifests is not None:
        extra.append(bad_manifests.select(F.concat(F.lit("invalid-manifest:"), "path").alias("subject"), F.array(issue("MANIFEST_INVALID", F.col("code"))).alias("issues")))
    rows = reduce(DataFrame.unionByName, [sources, *extra]).withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    return rows.select("subject", (F.size("issues") == 0).alias("ok"), "issues")


def current_artifacts(revisions: DataFrame) -> DataFrame:
    """The last revision of each source."""
    last = Window.partitionBy("source_id").orderBy(F.desc("revision"))
    return revisions.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
