"""Structured Streaming forms of the keyed-state operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions import text as T
from lodestone.operators import index, media, timeline


def progress_stream(progress: DataFrame, phases: dict[str, tuple[int, int]]) -> DataFrame:
    """source_id, seq, percent with a running maximum kept per source (see the batch form).
    Chunks of a key's batch are taken one by one, as they come; sorted by seq within each."""
    raw = timeline.raw_percent(phases, F.col("phase"), F.col("completed"), F.col("total"))
    rows = progress.select("source_id", "seq", raw.alias("raw"))

    def step(key, batches, state: GroupState):
        (best,) = state.get if state.exists else (0,)
        for rows in batches:
            rows = rows.sort_values("seq")
            percent = rows["raw"].cummax().clip(lower=best).astype("int32")
            best = int(percent.iloc[-1])
            yield pd.DataFrame({"source_id": key[0], "seq": rows["seq"], "percent": percent})
        state.update((best,))

    return rows.groupBy("source_id").applyInPandasWithState(step, "source_id long, seq long, percent int", "best int", "append", GroupStateTimeout.NoTimeout)


def session_stream(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session bounds and events per gap session, with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return found.select("user_id", F.col("s.start").alias("first_ts"), F.col("s.end").alias("last_ts"), "n_events")


def new_contents(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents whose content hash was not seen within the horizon (needs doc_id and ts). A
    null text has no content and no hash; each document without text comes through."""
    hash_ = F.sha2("text", 256)
    hashed = documents.withColumns({"hash": hash_, "content_key": F.coalesce(hash_, F.concat(F.lit("none-"), F.col("doc_id").cast("string")))}).withWatermark("ts", late)
    return hashed.dropDuplicatesWithinWatermark(["content_key"]).drop("content_key")


def intake_batches(documents: DataFrame, table_path: str, checkpoint: str):
    """Writes the documents whose content the table does not hold yet, batch by batch.

    A batch writes its own folder and compares with the folders of other batches only, so a
    batch that is replayed after a failure replaces what it wrote. Only the column of hashes is
    read of what is there. Null texts have no hash, are no duplicates and are all written.
    """

    def write(batch: DataFrame, number: int):
        spark = batch.sparkSession
        hashed = batch.withColumn("hash", F.sha2("text", 256))
        fresh = hashed.where("hash IS NOT NULL").dropDuplicates(["hash"]).unionByName(hashed.where("hash IS NULL"))
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            seen = spark.read.parquet(table_path)
            if "batch" in seen.columns:
                fresh = fresh.join(seen.where(F.col("batch") != number).select("hash"), "hash", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def settled_files(listings: DataFrame) -> DataFrame:
    """path, size, mtime of files whose size and mtime were the same in two polls in a row.
    `listings` streams (poll, path, size, mtime); a file is told again only after a change."""

    def step(key, batches, state: GroupState):
        seen = state.get if state.exists else (None, None, False)
        out = []
        for rows in batches:
            for row in rows.sort_values("poll").itertuples(index=False):
                same = seen[:2] == (row.size, row.mtime)
                if same and not seen[2]:
                    out.append((key[0], row.size, row.mtime))
                seen = (int(row.size), int(row.mtime), same)
        state.update(seen)
        yield pd.DataFrame(out, columns=["path", "size", "mtime"])

    rows = listings.select("poll", "path", "size", "mtime")
    return rows.groupBy("path").applyInPandasWithState(step, "path string, size long, mtime long", "size long, mtime long, told boolean", "append", GroupStateTimeout.NoTimeout)


def index_updates(events: DataFrame, table_path: str, checkpoint: str):
    """Keeps a table of page links up to date with a stream of file events (seq, path, content;
    null content: deleted); `current_links` reads it.

    A batch takes the last event of each path and writes those pages' links alone, as a folder
    of its own; what is there is neither read nor written again. A batch that is replayed
    replaces its folder.
    """

    def write(batch: DataFrame, number: int):
        last = batch.groupBy("path").agg(F.max_by(F.struct("content"), "seq").alias("e"), F.max("seq").alias("seq")).select("path", "seq", F.col("e.content").alias("content"))
        links = index.page_links(last.where("content IS NOT NULL")).groupBy("from_path").agg(F.array_sort(F.collect_set("to_path")).alias("links"))
        rows = last.select(T.page_key(F.col("path")).alias("from_path"), "seq", F.col("content").isNull().alias("gone")).join(links, "from_path", "left")
        rows.select("from_path", "seq", "gone", F.coalesce("links", F.array().cast("array<string>")).alias("links")).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_links(spark, table_path: str) -> DataFrame:
    """from_path, to_path: the links of each page's last event in an `index_updates` table."""
    last = spark.read.parquet(table_path).groupBy("from_path").agg(F.max_by(F.struct("gone", "links"), F.struct("batch", "seq")).alias("e"))
    return last.where("NOT e.gone").select("from_path", F.explode("e.links").alias("to_path"))


def compacted(spark, table_path: str, target: str) -> None:
    """Writes an `index_updates` table anew with the last row of each page that is there, as
    its batch -1, for a stream to go on with."""
    last = spark.read.parquet(table_path).groupBy("from_path").agg(F.max_by(F.struct("seq", "gone", "links"), F.struct("batch", "seq")).alias("e"))
    last.where("NOT e.gone").select("from_path", "e.*").write.mode("overwrite").parquet(f"{target}/batch=-1")


def run_stream(events: DataFrame, keep: int = 50) -> DataFrame:
    """run_id, state, iterations, n_activities: snapshots of runs (run_id, seq, type,
    iteration, tool_call_id) as they go on; text events change nothing and the first event
    that ends a run closes it. The last `keep` activities are held."""

    def step(key, batches, state: GroupState):
        status, iterations, activities = state.get if state.exists else ("running", 0, "")
        held = activities.split(",") if activities else []
        for rows in batches:
            for row in rows.sort_values("seq").itertuples(index=False):
                if row.type == "text" or status in media.ENDS.values():
                    continue
                status = media.ENDS.get(row.type, "waiting" if row.type == "plan_ready" else status)
                iterations = max(iterations, 0 if pd.isna(row.iteration) else int(row.iteration))
                if row.type.startswith("tool_"):
                    held = [*held, str(row.tool_call_id)][-keep:]
        state.update((status, iterations, ",".join(held)))
        yield pd.DataFrame({"run_id": [key[0]], "state": [status], "iterations": [iterations], "n_activities": [len(held)]})

    rows = events.select("run_id", "seq", "type", "iteration", "tool_call_id")
    kind = dict(events.dtypes)["run_id"]
    return rows.groupBy("run_id").applyInPandasWithState(step, f"run_id {kind}, state string, iterations int, n_activities int", "state string, iterations int, activities string", "update", GroupStateTimeout.NoTimeout)
