"""Jobs on a timer: what the store does every few seconds or minutes, driven by a stream's micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnlake.operators import catalog, lifecycle


def every(spark: SparkSession, seconds: float, job: Callable[[int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Runs ``job(number)`` every so many seconds until the query is stopped; a job that takes longer delays the next."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    out = ticks.writeStream.trigger(processingTime=f"{int(seconds * 1000)} milliseconds").foreachBatch(lambda _, number: job(number))
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def gauges(files: DataFrame, blobs: DataFrame, volumes: DataFrame) -> DataFrame:
    """(name, value) of the store's gauges."""
    f = files.agg(F.count("*").alias("files_total"))
    b = blobs.agg(F.count("*").alias("blobs_total"))
    v = volumes.agg(F.count("*").alias("volumes_total"), F.coalesce(F.sum("size_total"), F.lit(0)).alias("storage_total_bytes"), F.coalesce(F.sum("size_deleted"), F.lit(0)).alias("storage_deleted_bytes"))
    one = f.join(b).join(v)  # one row each
    return one.unpivot([], one.columns, "name", "value")


def purge(files: DataFrame, blobs: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(blobs, freed bytes by volume) after the pending blobs that no one finished are dropped."""
    return lifecycle.purged(blobs, catalog.stale_pending(blobs, files, cutoff))


def expire(files: DataFrame, blobs: DataFrame, volumes: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, blobs, volumes) after the files whose time is over are dropped."""
    return lifecycle.deleted(files, blobs, volumes, catalog.expired(files, now))
