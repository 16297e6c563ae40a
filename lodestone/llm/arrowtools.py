"""Small helpers that every Arrow-mapped operator of this subpackage shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\v\f\r"
#: Rows handed to a row function at once; long texts make smaller groups.
GROUP_BYTES = 4 << 20
#: Bytes of a batch of rows that Spark hands to a task.
BATCH_BYTES = 8 << 20


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the ids that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than ASCII white space; null has none."""
    return text.encode().split() if text else []


def groups(batch: pa.RecordBatch, text: int, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts together take about `limit` bytes."""
    start, taken = 0, 0
    column = batch.column(text)
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if taken and taken + n > limit:
            yield batch.slice(start, i - start)
            start, taken = i, 0
        taken += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, columns: list[str], schema: str, make: Callable, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Runs `make()` once per task; its result maps column lists to output columns.

    Only `columns` are read. Groups of rows are bounded by the bytes of their texts,
    so a task's memory does not depend on how long its partition is. `carry` columns
    are copied to the output untouched, behind the others.
    """
    at, kinds = columns.index(text), dict(df.dtypes)
    schema = ", ".join([schema, *(f"`{c}` {kinds[c]}" for c in carry)])
    read = [*columns, *(c for c in carry if c not in columns)]

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # what a worker frees goes back to the machine
        f = make()
        for batch in batches:
            for part in groups(batch, at):
                out = f(*(c.to_pylist() for c in part.columns[: len(columns)]))
                out |= {c: part.column(read.index(c)) for c in carry}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.select(*read).mapInArrow(run, schema)


def bounded_batches(spark: SparkSession) -> None:
    """Jobs hand at most BATCH_BYTES to Python at once, unless the session says otherwise.

    It holds for all jobs of the session from then on, so pipelines that run side by side
    find the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the cluster's shared folder.

    The folder is read from the session. Where none is set, a temporary one is taken by a
    local session, as in tests, and a cluster gets an error: its executors could not see it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
