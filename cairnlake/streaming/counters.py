"""Structured streams over the store's event log. An extension: the store itself only polls on a timer.

Both keep their state bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.text import normal_path


def request_counts(requests: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests (ts, method, path, status) counted by window, method, normalised path and status."""
    kept = requests.where("path <> '/metrics'").withWatermark("ts", late)
    by = kept.groupBy(F.window("ts", width).alias("w"), "method", normal_path(F.col("path")).alias("path"), "status").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("started"), "method", "path", "status", "n")


def first_uploads(uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """Of uploads (ts, hash, ...) the first of each content; copies that come within the watermark go."""
    return uploads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])
