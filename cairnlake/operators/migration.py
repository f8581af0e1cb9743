"""Files of an older store: found by number, unpacked, turned into uploads, and held against what the store has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import text
from cairnlake.sources import volumes


def chosen(rows: DataFrame, reverse: bool = False, limit: int = 0) -> DataFrame:
    """Rows by ``raw_id``, rising or falling, the first ``limit`` or all."""
    out = rows.orderBy(F.desc("raw_id") if reverse else "raw_id")
    return out.limit(limit) if limit else out


def requests(rows: DataFrame, folder: str) -> DataFrame:
    """Upload requests of (raw_id, legacy_id, name, tags); ``content`` is null where the source file is missing."""
    placed = rows.withColumn("path", text.legacy_path(F.col("raw_id"))).withColumn("name", text.basename(F.col("name")))
    found = volumes.read_packed(placed, folder, "path").drop("path")
    return found.select(F.concat(F.lit("m-"), F.col("legacy_id").cast("string")).alias("request_id"), F.col("raw_id").alias("seq"), "name", "content", F.lit("").alias("content_type"), "legacy_id", F.lit("").alias("validity"), "tags")


def mismatches(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(legacy_id, status, json) of the source files that the store lacks or has otherwise; hashes are compared."""
    old = wanted.select("legacy_id", F.sha2("content", 256).alias("_old"))
    new = stored.select("legacy_id", F.sha2("content", 256).alias("_new"))
    status = F.when(F.col("_old").isNull(), "source_missing").when(F.col("_new").isNull(), "missing").when(F.col("_old") != F.col("_new"), "hash_mismatch")
    found = old.join(new, "legacy_id", "left").select("legacy_id", status.alias("status")).where("status is not null")
    return found.withColumn("json", F.to_json(F.struct("legacy_id", "status")))


def write_report(found: DataFrame, folder: str) -> DataFrame:
    """Writes the mismatches as JSON lines under ``folder``/mismatches and their number and time under /summary; returns the latter."""
    found.select("json").write.mode("overwrite").text(f"{folder}/mismatches")
    summary = found.sparkSession.read.text(f"{folder}/mismatches").agg(F.current_timestamp().alias("timestamp"), F.count("*").alias("total_mismatches"))
    summary.write.mode("overwrite").json(f"{folder}/summary")
    return found.sparkSession.read.json(f"{folder}/summary")
