"""The store's series as one table of names, labels and values."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import normal_path


def labels(**columns: str) -> Column:
    """``a=x,b=y`` of the columns; empty without any."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in columns.items()])


def series(requests: DataFrame, uploads: DataFrame, volumes: DataFrame, at: str) -> DataFrame:
    """(name, labels, value) of all series.

    ``requests`` has ts, method, path, status, duration_s and bytes_read, without those for the metrics themselves;
    ``uploads`` status, file_type, duration_s, bytes_written and is_dedup. Requests in flight are those under way at ``at``.
    """
    own = requests.where("path <> '/metrics'").withColumn("path", normal_path(F.col("path")))
    moment = F.lit(at).cast("timestamp_ntz")
    ends = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("duration_s").cast("decimal(18,6)"))

    def one(df: DataFrame, name: str, value: Column, **by: str) -> DataFrame:
        return df.groupBy(*by.values()).agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), labels(**by).alias("labels"), "value")

    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    found = [
        one(own, "http_requests_total", F.count("*"), method="method", path="path", status="status"),
        one(own, "http_request_duration_seconds_sum", F.round(total("duration_s"), 6), method="method", path="path"),
        one(own, "http_requests_in_flight", F.count_if((F.col("ts") <= moment) & (ends > moment))),
        one(uploads, "upload_ops_total", F.count("*"), status="status", file_type="file_type"),
        one(uploads, "upload_duration_seconds_sum", F.round(total("duration_s"), 6)),
        one(uploads, "storage_dedup_hits_total", F.count_if(F.col("is_dedup") & (F.col("status") == "success"))),
        one(volumes, "storage_deleted_bytes_total", total("size_deleted")),
        one(volumes, "storage_bytes_total", total("size_total")),
        one(uploads, "blob_bytes_written_total", total("bytes_written")),
        one(own, "blob_bytes_read_total", total("bytes_read")),
    ]
    return functools.reduce(DataFrame.unionAll, found)
