"""Scans of an inbox: what is new is imported, and the counts come with the write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.decoding import decode_text
from lodestone.sources.intake import MAX_DOCUMENT
from lodestone.storage import bounded_batches

#: What a file may end as.
IMPORTED, DUPLICATE, FAILED = "imported", "duplicate", "failed"


def accepted(path: str = "path", folder: str = "") -> Column:
    """Whether a file is one for the inbox: Markdown, and no hidden file or folder below it."""
    below = F.substring(F.col(path), len(folder) + 1, 1 << 30)
    return F.lower(path).endswith(".md") & ~below.rlike(r"(^|/)\.")


def read_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", "content")


def judged(files: DataFrame, known: DataFrame, max_bytes: int = MAX_DOCUMENT) -> DataFrame:
    """path, status, reason, hash, original, text of an inbox's files (path, length, content).

    A file whose bytes `known` (hash, source_id) or an earlier file has is a duplicate, of the
    one in `original`; of files with the same bytes the least path is imported. Files that are
    too large or are no text have failed, with a reason; so has one without content.
    """
    bounded_batches(files.sparkSession)
    rows = files.where(accepted()).select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    read = rows.select("path", "length", F.sha2("content", 256).alias("hash"), decode_text(F.col("content")).alias("text"))
    reason = F.when(F.coalesce("length", F.lit(0)) > max_bytes, "SOURCE_TOO_LARGE").when(F.col("hash").isNull(), "SOURCE_UNREADABLE").when(F.col("text").isNull(), "UNSUPPORTED_ENCODING")
    read = read.withColumn("reason", reason)
    stored = known.groupBy("hash").agg(F.min(F.col("source_id").cast("string")).alias("known_id"))
    # Equal bytes may be many: the least path of a hash is found by a partial aggregate.
    first = read.where("reason IS NULL").groupBy("hash").agg(F.min("path").alias("first_path"))
    joined = read.join(first, "hash", "left").join(stored, "hash", "left")
    original = F.when(F.col("reason").isNull(), F.coalesce("known_id", F.when(F.col("first_path") != F.col("path"), F.col("first_path"))))
    status = F.when(F.col("reason").isNotNull(), FAILED).when(original.isNotNull(), DUPLICATE).otherwise(IMPORTED)
    return joined.select("path", status.alias("status"), "reason", "hash", original.alias("original"), F.when(status == IMPORTED, F.col("text")).alias("text"))


def write_counted(rows: DataFrame, write: Callable[[DataFrame], object], name: str = "scan") -> tuple[dict[str, int], object]:
    """Writes judged rows by `write`, and counts them on the way: imported, duplicates, failed
    and the bytes imported. The counts are metrics of that one job; nothing is read again.

    A task that is run again counts once: metrics come with the attempt that Spark keeps.
    """
    seen = Observation(name)
    count = lambda status: F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0))
    size = F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))
    out = write(rows.observe(seen, count(IMPORTED).alias("imported"), count(DUPLICATE).alias("duplicates"), count(FAILED).alias("failed"), size.alias("bytes")))
    return dict(seen.get), out


def scan(spark: SparkSession, folder: str, known: DataFrame, table: str) -> tuple[dict[str, int], DataFrame]:
    """(counts, failures) of one scan of an inbox folder: what is new is appended to `table`,
    a folder of Parquet; failures are path and reason of files that could not be imported.

    All statuses are written, a folder for each, so that the counts and the failures belong
    to the same pass."""
    rows = judged(read_inbox(spark, folder), known)
    counts, _ = write_counted(rows, lambda df: df.write.mode("append").partitionBy("status").parquet(table))
    failures = spark.read.parquet(table).where(F.col("status") == FAILED).select("path", "reason").distinct()
    return counts, failures


def known_sources(spark: SparkSession, table: str) -> DataFrame:
    """hash, source_id of what a table of scans holds, for the next one."""
    held = spark.read.parquet(table).where(F.col("status") == IMPORTED)
    first = Window.partitionBy("hash").orderBy("path")
    return held.withColumn("n", F.row_number().over(first)).where("n = 1").select("hash", F.col("path").alias("source_id"))
