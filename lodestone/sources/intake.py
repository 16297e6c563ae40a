"""Intake: source types from bytes, content-addressed de-duplication, URL routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


#: Extensions of media files; below, the types and first bytes of all kinds.
AUDIO = ["wav", "mp3", "m4a", "mpga", "mpeg", "ogg", "oga", "flac"]
VIDEO = ["mp4", "mov", "webm", "mkv", "avi"]
#: Bytes that a document and a medium may have.
MAX_DOCUMENT, MAX_MEDIA = 50 << 20, 500 << 20


def detect(name: Column, content: Column, caption_mime: str = "application/json") -> Column:
    """kind, extension, mime and error of a file, from its first 64 bytes and its name. Caption
    packages are JSON; `caption_mime` is the type that their store knows them by."""
    head = F.hex(F.substring(content, 1, 64))
    last = F.lower(F.element_at(F.split(name, r"\."), -1))
    at = lambda start, text: F.substring(head, 2 * start + 1, 2 * len(text)) == text.encode().hex().upper()
    brand = F.lower(F.decode(F.unhex(F.substring(head, 17, 16)), "ISO-8859-1"))
    found = lambda kind, extension, mime: F.struct(F.lit(kind).alias("kind"), (F.lit(extension) if isinstance(extension, str) else extension).alias("extension"), F.lit(mime).alias("mime"), F.lit(None).cast("string").alias("error"))
    failed = lambda code: F.struct(F.lit("unknown").alias("kind"), last.alias("extension"), F.lit(None).cast("string").alias("mime"), F.lit(code).alias("error"))
    plain = F.regexp_replace(last, "[^a-z0-9]", "")
    return (
        F.when(at(0, "%PDF-"), found("pdf", "pdf", "application/pdf"))
        .when(last == "pdf", failed("UNSUPPORTED_FORMAT"))
        .when(last.isin("md", "markdown"), found("markdown", "md", "text/markdown"))
        .when(last == "txt", found("text", "txt", "text/plain"))
        .when(last == "bili-caption", found("video", "bili-caption", caption_mime))
        .when(at(0, "RIFF") & at(8, "WAVE"), found("audio", "wav", "audio/wav"))
        .when(at(0, "RIFF") & at(8, "AVI "), found("video", "avi", "video/x-msvideo"))
        .when(at(0, "ID3") | head.rlike("^FF[EF]"), found("audio", "mp3", "audio/mpeg"))
        .when(at(0, "fLaC"), found("audio", "flac", "audio/flac"))
        .when(at(0, "OggS"), found("audio", F.when(last == "oga", "oga").otherwise("ogg"), "audio/ogg"))
        .when(head.startswith("1A45DFA3"), found("video", F.when(last == "mkv", "mkv").otherwise("webm"), "video/webm"))
        .when(at(4, "ftyp") & ((last == "m4a") | brand.contains("m4a")), found("audio", "m4a", "audio/mp4"))
        .when(at(4, "ftyp") & ((last == "mov") | brand.contains("qt")), found("video", "mov", "video/quicktime"))
        .when(at(4, "ftyp"), found("video", "mp4", "video/mp4"))
        .when(last.isin(AUDIO + VIDEO), failed("MEDIA_MAGIC_MISMATCH"))
        .otherwise(found("unknown", F.when(plain == "", "bin").otherwise(plain), "application/octet-stream"))
    )


def detect_kind(name: Column, content: Column) -> Column:
    """The kind of a file, or the error code where name and bytes disagree."""
    both = detect(name, content)
    return F.coalesce(both["error"], both["kind"])


def read_originals(spark, path: str, max_document: int = MAX_DOCUMENT, max_media: int = MAX_MEDIA) -> DataFrame:
    """path, length, content, hash, kind, error of all files below a folder.

    Files over the greater limit are not read; those over the limit of their kind come
    without content. Both are rows with the error SOURCE_TOO_LARGE.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    limit = F.when(name.isin(AUDIO + VIDEO), max_media).otherwise(max_document)
    fits = files.where(F.col("length") <= max(max_document, max_media)).withColumn("fits", F.col("length") <= limit)
    content = F.when(F.col("fits"), F.col("content"))
    read = fits.select("path", "length", content.alias("content"), F.sha2(content, 256).alias("hash"), F.when(F.col("fits"), detect_kind(F.col("path"), F.col("content"))).alias("kind"), F.when(~F.col("fits"), "SOURCE_TOO_LARGE").alias("error"))
    large = files.where(F.col("length") > max(max_document, max_media)).select("path", "length", *(F.lit(None).cast(k).alias(c) for c, k in (("content", "binary"), ("hash", "string"), ("kind", "string"))), F.lit("SOURCE_TOO_LARGE").alias("error"))
    return read.unionByName(large)


def verify_originals(originals: DataFrame, manifests: DataFrame) -> DataFrame:
    """source_id, code: stored files that are gone or whose bytes have another hash than
    the manifest (source_id, path, hash) says."""
    found = manifests.join(originals.select("path", F.col("hash").alias("now")), "path", "left")
    return found.select("source_id", F.when(F.col("now").isNull(), "OBJECT_MISSING").when(F.col("now") != F.col("hash"), "OBJECT_HASH_MISMATCH").alias("code")).where("code IS NOT NULL")


def object_path(content_hash: Column, extension: Column) -> Column:
    """Where a content-addressed store keeps an object."""
    return F.concat(F.lit("objects/sha256/"), F.substring(content_hash, 1, 2), F.lit("/"), content_hash, F.lit("."), extension)


def read_pages(spark, path: str) -> DataFrame:
    """path, content of all Markdown files below a folder."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def intake(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """source_id, hash, original_id, duplicate: rows whose content is new keep their own id;
    others point at the known or the first incoming row with the same bytes. A null text has
    the bytes of none: its hash is null and it is no duplicate. Of known rows that share a
    hash the least id counts."""
    hashed = incoming.select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("hash"))
    first = hashed.where("hash IS NOT NULL").groupBy("hash").agg(F.min("source_id").alias("first_id"))
    stored = known.groupBy("hash").agg(F.min("source_id").alias("known_id"))
    joined = hashed.join(first, "hash", "left").join(stored, "hash", "left")
    original = F.coalesce("known_id", "first_id", "source_id")
    return joined.select("source_id", "hash", original.alias("original_id"), (original != F.col("source_id")).alias("duplicate"))


def backfill(known: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Known rows (hash and `columns`) with their empty provenance filled from incoming rows
    of the same hash, the first by source_id that has a value; no row is added."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("source_id"))).alias(f"new_{c}") for c in columns]
    found = incoming.groupBy("hash").agg(*firsts)
    joined = known.join(found, "hash", "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"new_{c}")).alias(c) if c in columns else F.col(c) for c in known.columns])


def rank_parsers(sources: DataFrame, parsers: DataFrame) -> DataFrame:
    """source_id, parser_id: the best enabled parser for each source's kind, null where there
    is none. `parsers` is a configuration table."""
    fit = sources.join(parsers.where("enabled AND supported"), "kind", "left")
    order = Window.partitionBy("source_id").orderBy(F.desc("confidence"), F.desc("priority"), "parser_id")
    return fit.withColumn("n", F.row_number().over(order)).where("n = 1").select("source_id", "parser_id")


def url_hygiene(pages: DataFrame) -> DataFrame:
    """page_id, url without secrets, whether it is acceptable, and its route."""
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    route = F.when(~T.url_acceptable(url), "rejected").when(host.rlike(r"(^|\.)(bilibili\.com|douyin\.com)$"), "video").otherwise("web")
    return pages.select("page_id", T.clean_url(url).alias("url"), T.url_acceptable(url).alias("acceptable"), route.alias("route"))
