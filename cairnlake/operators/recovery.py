"""Integrity of volumes on disk, and catalogs and files rebuilt from volumes and log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.ordered import earliest, latest
from cairnlake.schema import OVERHEAD
from cairnlake.sources import volumes
from cairnlake.sources.formats import unpack


def missing_volumes(blobs: DataFrame, listed: DataFrame) -> DataFrame:
    """(volume_id) of the volumes that blobs lie in and that have no file in the listing (volume_id, name, bytes)."""
    return blobs.where("volume_id is not null").select("volume_id").distinct().join(listed.select("volume_id"), "volume_id", "left_anti")


def deep_integrity(blobs: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """One row: committed blobs that can't be read at their place, missing volumes, orphans, missing blobs, and the verdict.

    Pending blobs have no place yet; they are counted and not looked for.
    """
    there = blobs.where("state = 'committed'")
    lost = there.where("volume_id is null or blob_offset is null")
    read = volumes.read_blobs(there.where("volume_id is not null and blob_offset is not null"), folder)
    checked = read.select("readable").unionAll(lost.select(F.lit(False))).agg(F.count("*").alias("checked"), F.count_if(~F.col("readable")).alias("unreadable"))
    pending = blobs.agg(F.count_if(F.col("state") == "pending").alias("pending"))
    gone = missing_volumes(there, volumes.read_records(blobs.sparkSession, "files", folder)).agg(F.count("*").alias("missing_volumes"))
    orphans = blobs.join(files.select("blob_id"), "blob_id", "left_anti").agg(F.count("*").alias("orphan_blobs"))
    missing = files.join(blobs.select("blob_id"), "blob_id", "left_anti").agg(F.count("*").alias("missing_blobs"))
    one = checked.join(pending).join(gone).join(orphans).join(missing)  # one row each
    wrong = (F.col("unreadable") > 0) | (F.col("missing_blobs") > 0) | (F.col("missing_volumes") > 0)
    return one.withColumn("status", F.when(wrong, "error").when(F.col("orphan_blobs") > 0, "warning").otherwise("ok"))


def rebuilt(records: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blobs, files, volumes) from what is on disk: the first record of a blob, the last log record of a file of a name."""
    placed = earliest(records.withColumn("_at", F.struct("volume_id", "offset")), ["blob_id"], "_at")
    raw = unpack(F.col("payload"), F.col("algorithm"))
    blobs = placed.withColumn("_raw", raw).select("blob_id", "volume_id", F.col("offset").alias("blob_offset"), F.col("size").alias("size_compressed"), F.octet_length("_raw").cast("long").alias("size_raw"), F.sha2("_raw", 256).alias("hash"), F.col("algorithm").alias("compression_alg"))
    files = latest(log, ["blob_id", "name"], "seq").join(blobs.select("blob_id"), "blob_id", "left_semi")
    volumes = records.groupBy("volume_id").agg(F.sum(F.col("size") + OVERHEAD).alias("size_total"), F.count("*").alias("records"))
    return blobs, files, volumes


def recovered(records: DataFrame, log: DataFrame) -> DataFrame:
    """Files of the log with their content, from the last record of their blob; log records without a blob stay out."""
    last = latest(records.withColumn("_at", F.struct("volume_id", "offset")), ["blob_id"], "_at")
    found = log.join(last.select("blob_id", "payload", "algorithm"), "blob_id")
    return found.select("file_id", "name", "blob_id", unpack(F.col("payload"), F.col("algorithm")).alias("content"))
