"""State changes as functions from tables and requests to the new rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.ordered import numbered
from cairnlake.schema import OVERHEAD


def deleted(files: DataFrame, blobs: DataFrame, volumes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, blobs, volumes) after the files of the ids in ``gone`` go, with blobs that no file uses any more.

    Ids that name no file do nothing. The framed bytes of dropped blobs are added to their volumes' deleted bytes.
    """
    ids = gone.select("file_id").distinct()
    left = files.join(ids, "file_id", "left_anti")
    candidates = files.join(ids, "file_id", "left_semi").select("blob_id").distinct()
    dead = candidates.join(left.select("blob_id"), "blob_id", "left_anti")
    freed = blobs.join(dead, "blob_id", "left_semi").where("volume_id is not null").groupBy("volume_id").agg(F.sum(F.col("size_compressed") + OVERHEAD).alias("_freed"))
    grown = volumes.join(freed, "volume_id", "left").select("volume_id", "size_total", (F.col("size_deleted") + F.coalesce("_freed", F.lit(0))).alias("size_deleted"))
    return left, blobs.join(dead, "blob_id", "left_anti"), grown


def purged(blobs: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs without the stale ones, framed bytes to add to each volume for those that had been written)."""
    rows = blobs.join(stale.select("blob_id"), "blob_id", "left_semi").where("volume_id > 0 and size_compressed > 0")
    return blobs.join(stale.select("blob_id"), "blob_id", "left_anti"), rows.groupBy("volume_id").agg(F.sum(F.col("size_compressed") + OVERHEAD).alias("freed"))


def committed(blobs: DataFrame, written: DataFrame) -> DataFrame:
    """Blobs with the locations in ``written`` (blob_id, volume_id, blob_offset, size_compressed), committed and without lease."""
    new = written.select("blob_id", *[F.col(c).alias(f"_{c}") for c in ("volume_id", "blob_offset", "size_compressed")])
    hit = F.col("_volume_id").isNotNull()
    joined = blobs.join(new, "blob_id", "left")
    put = {c: F.coalesce(f"_{c}", c) for c in ("volume_id", "blob_offset", "size_compressed")}
    lease = {"state": F.when(hit, "committed").otherwise(F.col("state")), "write_owner": F.when(~hit, F.col("write_owner")), "write_started_at": F.when(~hit, F.col("write_started_at"))}
    return joined.select(*[(put | lease).get(c, F.col(c)).alias(c) for c in blobs.columns])


def added(totals: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Upsert: the changes are added to the rows of their key; new keys get rows of their own."""
    both = totals.select(key, column).unionByName(changes.select(key, column))
    return both.groupBy(key).agg(F.sum(column).alias(column))


def dimension(rows: DataFrame, wanted: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The dimension with the wanted combinations that it lacked, numbered on from its greatest key."""
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    lacking = wanted.select(*by).distinct().join(rows.select(*by), by, "left_anti")
    fresh = numbered(lacking.withColumn("_order", F.concat_ws("\x1f", *by)), "_order", "_n").join(F.broadcast(top))
    return rows.unionByName(fresh.select((F.col("_top") + F.col("_n")).alias(key), *by))


def saved_files(files: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of requests (request_id, blob_id, name, expires_at): the file they meet, or themselves as a new one."""
    held = files.groupBy("blob_id", "name", "expires_at").agg(F.min("file_id").alias("_met"))  # a key of many files is one row
    r, f = requests.alias("r"), held.alias("f")
    same = (F.col("r.blob_id") == F.col("f.blob_id")) & (F.col("r.name") == F.col("f.name")) & F.col("r.expires_at").eqNullSafe(F.col("f.expires_at"))
    met = r.join(f, same, "left")
    return met.select("request_id", F.coalesce("_met", "request_id").alias("file_id"), F.col("_met").isNull().alias("inserted"))


def legacy_conflicts(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, legacy_id, blob_id): ``conflict`` where the id is already on another blob."""
    held = files.where("legacy_id is not null").groupBy("legacy_id").agg(F.min("blob_id").alias("_low"), F.max("blob_id").alias("_high"))
    other = (F.col("_low") != F.col("blob_id")) | (F.col("_high") != F.col("blob_id"))
    return requests.join(held, "legacy_id", "left").select("request_id", F.when(other, "conflict").otherwise("ok").alias("outcome"))


def next_id(files: DataFrame, counter: DataFrame) -> DataFrame:
    """(next_id): what the counter goes on with: its own next, one more than the greatest id in use, and 1 at least."""
    top = files.agg(F.max("legacy_id").alias("_top"))
    held = counter.agg(F.max("next_id").alias("_held"))
    return top.join(held).select(F.greatest(F.lit(1), F.coalesce("_held", F.lit(1)), F.coalesce(F.col("_top") + 1, F.lit(1))).cast("long").alias("next_id"))


def ensured(counter: DataFrame, ids: DataFrame) -> DataFrame:
    """The counter kept ahead of explicit ids (legacy_id)."""
    return next_id(ids, counter)


def allocated(counter: DataFrame, wanting: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the ids from the counter on, in the order of a column; the counter after them)."""
    given = numbered(wanting, order, "_n").join(F.broadcast(counter)).withColumn("legacy_id", F.col("next_id") + F.col("_n") - 1).drop("_n", "next_id")
    return given, counter.join(wanting.agg(F.count("*").alias("_more"))).select((F.col("next_id") + F.col("_more")).alias("next_id"))


def progress(rows: DataFrame, order: str, step: int = 100) -> DataFrame:
    """(number, percent) after every ``step`` rows."""
    total = rows.agg(F.count("*").alias("_total"))
    marks = numbered(rows.select(order), order, "number").where(F.col("number") % step == 0)
    return marks.join(F.broadcast(total)).select(F.col("number").cast("long").alias("number"), (F.col("number") / F.col("_total") * 100).alias("percent"))
