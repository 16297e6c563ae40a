"""Tables that are published whole: data and metadata become visible together, or not at all.

A publication writes a folder of its own, `v=NAME`, with data and metadata, and last of all a
pointer file, by a rename. Readers follow the pointer, so they see the version before or the
new one, never half of one; a writer that dies leaves a folder that nobody points to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def publish(data: DataFrame, metadata: dict, path: str, name: str | None = None) -> str:
    """Writes and then shows a version; returns its name. `metadata` is stored with it."""
    spark, name = data.sparkSession, name or uuid.uuid4().hex
    folder = f"{path}/v={name}"
    data.write.mode("overwrite").parquet(f"{folder}/data")
    spark.createDataFrame([(name, json.dumps(metadata, sort_keys=True))], "version string, metadata string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/metadata")
    files, path_of = _files(spark, path)
    fresh, pointer = path_of(f"{path}/.{POINTER}-{name}"), path_of(f"{path}/{POINTER}")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    # A rename that replaces: one step for whoever reads.
    options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(fresh), files.makeQualified(pointer), options)
    return name


def current(spark: SparkSession, path: str) -> str | None:
    """The version that is shown; None where none has been."""
    files, path_of = _files(spark, path)
    pointer = path_of(f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def published(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """(data, metadata) of the version that is shown."""
    name = current(spark, path)
    if name is None:
        return None
    folder = f"{path}/v={name}"
    return spark.read.parquet(f"{folder}/data"), json.loads(spark.read.parquet(f"{folder}/metadata").first().metadata)


def superseded(spark: SparkSession, path: str) -> list[str]:
    """Versions that are not shown: older ones and those that were never finished. To be
    removed when no reader is at them any more."""
    files, path_of = _files(spark, path)
    shown = current(spark, path)
    names = [s.getPath().getName().removeprefix("v=") for s in files.listStatus(path_of(path)) if s.isDirectory() and s.getPath().getName().startswith("v=")]
    return sorted(n for n in names if n != shown)
