"""Rows that several steps read, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows that Spark hands to a Python worker.
BATCH_BYTES = 8 << 20


def stored(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the folder that all executors share.

    Later plans start from it, so they are small and survive lost executors. Where no folder
    is set, a local session takes a temporary one, as in tests; a cluster gets an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Jobs hand at most BATCH_BYTES to Python at once, unless the session says otherwise: a
    batch is bounded by rows alone else, and rows that hold whole files may be large.

    It holds for all jobs of the session from then on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "-1"):
        spark.conf.set(key, str(BATCH_BYTES))
