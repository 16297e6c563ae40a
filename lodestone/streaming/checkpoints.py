"""Expiring checkpoints of chunked jobs, as keyed state with timers.

Every chunk that a job (job_id) completes refreshes its checkpoint, which lives for the
retention time behind the event's time. When the watermark passes that, the timer removes
the checkpoint and tells it. A chunk of another source hash than the checkpoint's starts the
job anew: what was done belongs to bytes that are gone.

`expiring` is the stream, `replayed` the same rule over a table, by windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: hours that a checkpoint is kept behind its last chunk.
RETENTION_HOURS = 24
OUTPUT = "job_id string, state string, source_hash string, chunks int, expires_at timestamp"
#: What the state store must be for timers and maps.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Checkpoints(StatefulProcessor):
    """Rows (ts, source_hash, chunk) of a job -> a row for each refresh and for each end."""

    def __init__(self, retention_ms: int):
        self.retention = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "source_hash string, expires long")
        self.done = handle.getMapState("done", "chunk int", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A batch's chunks in the order of their times; they refresh the checkpoint together."""
        found = pd.concat(rows, ignore_index=True).sort_values(["ts", "chunk"], kind="stable")
        held = self.head.get() if self.head.exists() else None
        source, expires = held if held else (None, 0)
        for ts, digest, chunk in zip(found["ts"].astype("datetime64[ms]").astype("int64"), found["source_hash"], found["chunk"], strict=True):
            digest = None if pd.isna(digest) else digest
            if held and (digest != source or ts >= expires):
                yield self._told(key, "replaced" if digest != source else "expired", source, expires)
                self.done.clear()
                expires = 0
            held, source, expires = True, digest, max(expires, int(ts) + self.retention)
            self.done.updateValue((int(chunk),), (int(ts),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(expires)
        self.head.update((source, expires))
        yield self._told(key, "saved", source, expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        source, expires = self.head.get()
        yield self._told(key, "expired", source, expires)
        self.head.clear()
        self.done.clear()

    def close(self) -> None:
        pass

    def _told(self, key, state, source, expires) -> pd.DataFrame:
        chunks = sum(1 for _ in self.done.keys())
        return pd.DataFrame({"job_id": [key[0]], "state": [state], "source_hash": [source], "chunks": [chunks], "expires_at": [pd.Timestamp(expires, unit="ms")]})


def expiring(chunks: DataFrame, hours: float = RETENTION_HOURS, late: str = "10 minutes") -> DataFrame:
    """OUTPUT rows of a stream of completed chunks (job_id, ts, source_hash, chunk): "saved"
    once a batch and job, "expired" when nothing came for `hours`, "replaced" when the source
    changed. Chunks without a job, time or number are no chunks. Needs STORE as state store."""
    rows = chunks.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "source_hash", F.col("chunk").cast("int").alias("chunk")).where("job_id IS NOT NULL AND ts IS NOT NULL AND chunk IS NOT NULL")
    return rows.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(Checkpoints(int(hours * 3_600_000)), OUTPUT, "Append", "EventTime")


def replayed(chunks: DataFrame, hours: float = RETENTION_HOURS) -> DataFrame:
    """job_id, life (from 1), source_hash, chunks, started, expires_at, ending: the checkpoints
    that a table of chunks made, one after the other. One ends where the source changes
    ("replaced"), where a chunk comes after it has expired, or at last ("expired")."""
    rows = chunks.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "source_hash", F.col("chunk").cast("int").alias("chunk")).where("job_id IS NOT NULL AND ts IS NOT NULL AND chunk IS NOT NULL")
    job = Window.partitionBy("job_id").orderBy("ts", "chunk", "source_hash")
    before = F.lag(F.struct("ts", "source_hash")).over(job)
    span = F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    other = ~F.col("before.source_hash").eqNullSafe(F.col("source_hash"))
    rows = rows.withColumn("before", before).withColumn("new", F.when(F.col("before").isNull(), "first").when(other, "replaced").when(F.col("ts") >= F.col("before.ts") + span, "expired"))
    rows = rows.withColumn("life", F.count("new").over(job).cast("int"))
    lives = rows.groupBy("job_id", "life").agg(F.first("source_hash").alias("source_hash"), F.count_distinct("chunk").alias("chunks"), F.min("ts").alias("started"), (F.max("ts") + span).alias("expires_at"), F.max("new").alias("came"))
    following = F.lead("came").over(Window.partitionBy("job_id").orderBy("life"))
    return lives.select("job_id", "life", "source_hash", F.col("chunks").cast("int").alias("chunks"), "started", "expires_at", F.coalesce(following, F.lit("expired")).alias("ending"))
