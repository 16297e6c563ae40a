"""Manifests of sources, the operation log, parse keys, and states after a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ranking import numbered

MANIFEST = "schemaVersion int, id string, sourceHash string, importedAt string, kind string, acquiredBy string, name string, uri string, currentRevision int, revisions array<struct<revision:int,rawPath:string,contentHash:string,artifactSchemaVersion:int>>, _corrupt string"
#: What an interrupted attempt becomes, by the state it was left in.
RECOVERED = {"parsing": "failed", "planning": "failed", "awaiting_review": "failed", "waiting_remote": "resumable"}


def scan_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, errors) of the JSON files below a folder: valid rows, and path and code of
    files that are no JSON, miss a field or hold a hash that is none."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), "value", F.from_json("value", MANIFEST, {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"))
    m = F.col("m")
    code = (
        F.when(m.isNull() | m["_corrupt"].isNotNull() | m["schemaVersion"].isNull(), "invalid_json").when(F.coalesce(m["id"], F.lit("")) == "", "missing_id")
        .when(~F.coalesce(m["sourceHash"].rlike("^[a-f0-9]{64}$"), F.lit(False)), "invalid_hash").when(F.try_to_timestamp(m["importedAt"]).isNull(), "invalid_time")
    )
    judged = rows.withColumn("code", code)
    good = judged.where("code IS NULL").select("path", "m.*").drop("_corrupt")
    return upgraded(good), judged.where("code IS NOT NULL").select("path", "code")


def upgraded(manifests: DataFrame) -> DataFrame:
    """Manifests in their present form: version 3, a kind, who acquired them, and a schema
    version for each revision's artifact."""
    revisions = F.transform("revisions", lambda r: r.withField("artifactSchemaVersion", F.coalesce(r["artifactSchemaVersion"], F.lit(1))))
    kind = F.coalesce("kind", F.when(F.lower("name").endswith(".pdf"), "pdf").when(F.lower("name").rlike(r"\.(md|markdown)$"), "markdown").when(F.lower("name").endswith(".txt"), "text").otherwise("unknown"))
    return manifests.withColumns({"schemaVersion": F.lit(3), "kind": kind, "acquiredBy": F.coalesce("acquiredBy", F.lit("manual")), "revisions": revisions})


def by_import_time(manifests: DataFrame) -> DataFrame:
    """Manifests with their place, the last imported first."""
    return numbered(manifests, [], [F.desc("importedAt"), F.col("id")], "place")


def current_revisions(manifests: DataFrame) -> DataFrame:
    """id, revision, rawPath, contentHash: the revision that each manifest is at."""
    rows = manifests.select("id", "currentRevision", F.explode("revisions").alias("r"))
    return rows.where("r.revision = currentRevision").select("id", "r.revision", "r.rawPath", "r.contentHash")


def unmanaged_files(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """path of raw files that no revision of any manifest claims."""
    claimed = manifests.select(F.explode("revisions.rawPath").alias("path"))
    return files.select("path").join(claimed, "path", "left_anti")


def parse_key(source_hash: Column, parser_id: Column, version: Column, options: Column, fingerprint: Column) -> Column:
    """What a parse depends on, as one hash; options is a map, whose keys are put in order."""
    sorted_options = F.map_from_entries(F.array_sort(F.map_entries(options)))
    parts = F.to_json(F.struct(fingerprint.alias("fingerprint"), sorted_options.alias("options"), parser_id.alias("parserId"), source_hash.alias("sourceHash"), version.alias("version")))
    return F.sha2(parts, 256)


def reusable(work: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reuse, parse): work whose key a verified revision has, with its revision, and the rest."""
    verified = revisions.where("verified").groupBy("parse_key").agg(F.max("revision").alias("revision"))
    return work.join(verified, "parse_key"), work.join(verified, "parse_key", "left_anti")


def next_revisions(revisions: DataFrame) -> DataFrame:
    """source_id, revision: the number that a source's next revision gets."""
    return revisions.groupBy("source_id").agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))


def recent_operations(log: DataFrame, keep: int = 50) -> DataFrame:
    """The last operations of a log, newest first: that is the feature of the log."""
    return log.orderBy(F.desc("at"), "id").limit(keep)


def recovered(sources: DataFrame) -> DataFrame:
    """Sources after a restart: attempts that were under way have failed, or can be resumed
    where a remote service still works on them and a token is held."""
    table = F.create_map(*[F.lit(x) for pair in RECOVERED.items() for x in pair])
    state = F.coalesce(F.try_element_at(table, F.col("status")), F.col("status"))
    resumable = (state == "resumable") & (F.coalesce("resume_token", F.lit("")) == "")
    return sources.withColumn("recovered", (state != F.col("status"))).withColumn("status", F.when(resumable, "failed").otherwise(state))


def live_checkpoints(checkpoints: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Checkpoints (job_id, source_id, source_hash, expires_at) that have not expired and whose
    source still has their hash."""
    known = sources.select("source_id", F.col("hash").alias("source_hash"))
    return checkpoints.where(F.col("expires_at") > now).join(known, ["source_id", "source_hash"], "left_semi")
