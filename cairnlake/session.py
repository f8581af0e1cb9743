"""The folder that executors share, and tables cut off from their lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables that were written under the innermost contained().
_written: ContextVar[list[str]] = ContextVar("written", default=[])


def alone(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own JVM, so that they have what it has in memory and on its disk."""
    return bool(re.match(r"local(\[|$)", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where the session names none and is a single machine's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not alone(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "cairnlake-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, more: Iterable[DataFrame] = ()) -> tuple[DataFrame, str]:
    """(``df`` and then ``more`` of its kind as a table in the shared folder, its path); the table goes when the driver's JVM ends, or by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for rest in more:
        rest.write.mode("append").parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    _written.get().append(path)
    return spark.read.parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def contained(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, as a written table; the tables that it wrote on the way go."""
    inner: list[str] = []
    mark = _written.set(inner)
    try:
        made = make()
        path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
        made.write.parquet(path)
    finally:
        _written.reset(mark)
        for old in inner:
            drop(spark, old)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    _written.get().append(path)
    return spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared folder; later reads don't need its ancestors.

    A table rather than a checkpoint: a checkpoint keeps the constraints inferred for its plan, which grow without bound
    in loops.
    """
    return written(df)[0]
