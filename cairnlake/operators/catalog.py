"""Lookups, predicates, joins and aggregates over the catalog tables; every function is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.schema import OVERHEAD


def zero(c) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def share(part: Column, whole: Column) -> Column:
    """part / whole in percent; 0 where the whole is 0."""
    return F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0))


def same_file(files: DataFrame, wanted: DataFrame, with_legacy: bool) -> DataFrame:
    """For each wanted row the first file (by id) of the same blob and name, and null-safely the same expiry (and legacy id)."""
    keys = ["blob_id", "name", "expires_at"] + ["legacy_id"] * with_legacy
    w, f = wanted.alias("w"), files.groupBy(*keys).agg(F.min("file_id").alias("file_id")).alias("f")  # a key of many files is one row
    on = [F.col(f"w.{k}").eqNullSafe(F.col(f"f.{k}")) if k in ("expires_at", "legacy_id") else F.col(f"w.{k}") == F.col(f"f.{k}") for k in keys]
    return w.join(f, on).select("w.request_id", "f.file_id")


def expired(files: DataFrame, now: str) -> DataFrame:
    return files.where(F.col("expires_at").isNotNull() & (F.col("expires_at") < F.lit(now).cast("timestamp_ntz")))


def stale_pending(blobs: DataFrame, files: DataFrame, cutoff: str) -> DataFrame:
    old = F.col("write_started_at").isNull() | (F.col("write_started_at") < F.lit(cutoff).cast("timestamp_ntz"))
    return blobs.where((F.col("state") == "pending") & old).join(files.select("blob_id"), "blob_id", "left_anti")


def claimable(owner: str, now: str) -> Column:
    """A pending blob whose lease is free, own, or older than five minutes."""
    free = F.col("write_owner").isNull() | F.col("write_owner").isin("", owner) | F.col("write_started_at").isNull()
    return (F.col("state") == "pending") & (free | (F.col("write_started_at") < F.lit(now).cast("timestamp_ntz") - F.expr("interval '5' minute")))


def fragmented(volumes: DataFrame, percent: float) -> DataFrame:
    """Volumes with more than ``percent`` deleted; all that hold anything where it is 0 or less."""
    full = volumes.where("size_total > 0")
    return full if percent <= 0 else full.where(F.col("size_deleted").cast("double") / F.col("size_total") > percent / 100)


def file_info(files: DataFrame, blobs: DataFrame, types: DataFrame) -> DataFrame:
    """Files with their blob and type; files without either are an error and stay out (see broken_files)."""
    return files.join(blobs, "blob_id").join(types, "file_type_id")


def broken_files(files: DataFrame, blobs: DataFrame, types: DataFrame) -> DataFrame:
    """(file_id, error) of the files that file_info leaves out."""
    known = types.select("file_type_id", F.lit(True).alias("_type"))
    found = files.join(blobs.select("blob_id", "file_type_id", F.lit(True).alias("_blob")), "blob_id", "left").join(known, "file_type_id", "left")
    error = F.when(F.col("_blob").isNull(), "no blob").when(F.col("_type").isNull(), "no file type")
    return found.select("file_id", error.alias("error")).where("error is not null")


def inlined(info: DataFrame, contents: DataFrame) -> DataFrame:
    """Files' info with their whole content in base64; ``contents`` has (blob_id, content)."""
    return info.join(contents.select("blob_id", F.base64("content").alias("content_base64")), "blob_id")


def orphan_blobs(blobs: DataFrame, files: DataFrame) -> DataFrame:
    return blobs.join(files.select("blob_id"), "blob_id", "left_anti")


def missing_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    return files.join(blobs.select("blob_id"), "blob_id", "left_anti")


def quick_integrity(files: DataFrame, blobs: DataFrame) -> DataFrame:
    orphans = orphan_blobs(blobs, files).agg(F.count("*").alias("orphan_blobs"))
    both = orphans.join(missing_blobs(files, blobs).agg(F.count("*").alias("missing_blobs")))  # one row each
    return both.withColumn("status", F.when((F.col("orphan_blobs") > 0) | (F.col("missing_blobs") > 0), "warning").otherwise("ok"))


def storage_stats(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row of counts, sums and the ratios drawn from them."""
    b = blobs.agg(F.count("*").alias("blob_count"), zero(F.sum("size_raw")).alias("raw_bytes"), zero(F.sum("size_compressed")).alias("compressed_bytes"))
    f = files.agg(F.count("*").alias("file_count"))
    o = orphan_blobs(blobs, files).agg(zero(F.sum("size_compressed")).alias("orphan_bytes"))
    return b.join(f).join(o).select(
        "*",
        (F.col("file_count") - F.col("blob_count")).alias("dedup_count"),
        share(F.col("file_count") - F.col("blob_count"), F.col("file_count")).alias("dedup_pct"),
        F.when(F.col("raw_bytes") != 0, (1 - F.col("compressed_bytes") / F.col("raw_bytes")) * 100).otherwise(0.0).alias("compression_pct"),
        share(F.col("orphan_bytes"), F.col("compressed_bytes")).alias("orphan_pct"),
    )


def volume_report(volumes: DataFrame) -> DataFrame:
    return volumes.select("volume_id", "size_total", "size_deleted", (F.col("size_total") - F.col("size_deleted")).alias("used"), share(F.col("size_deleted"), F.col("size_total")).alias("fragmentation_pct"))


def framed_bytes(blobs: DataFrame) -> DataFrame:
    return blobs.where("volume_id is not null").groupBy("volume_id").agg(F.sum(F.col("size_compressed") + OVERHEAD).alias("framed"), F.count("*").alias("records"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts up to each bound, with sum and count: one pass, wide, then turned long."""
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count("*").alias("total"), F.sum(value).alias("value_sum"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])
    return wide.select(*by, F.explode(rows).alias("_b"), "total", "value_sum").select(*by, "_b.le", "_b.n", "total", "value_sum")
