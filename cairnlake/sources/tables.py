"""Upkeep of written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file of a tidied table.
FILE_BYTES = 128 << 20


def sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) of a table's folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop)
    return summary.getFileCount(), summary.getLength()


def tidied(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rewrites a parquet table into files of about ``file_bytes``; one row: files and bytes before and after.

    The new files are whole before the old ones go.
    """
    before = sizes(spark, path)
    draft = f"{path}-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    table.coalesce(max(1, -(-before[1] // file_bytes))).write.parquet(draft)
    old, new = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(draft)
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{draft}-old")
    system.rename(old, aside)
    system.rename(new, old)
    system.delete(aside, True)
    after = sizes(spark, path)
    return spark.createDataFrame([(*before, *after)], "files_before bigint, bytes_before bigint, files_after bigint, bytes_after bigint")
