"""Logic that depends on an order: running sums, first and last rows, numbering, placement."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.schema import OVERHEAD
from cairnlake.session import cut


def compaction_plan(blobs: DataFrame) -> DataFrame:
    """New offsets of the catalogued blobs of each volume; a window holds one volume, whose size is bounded."""
    before = Window.partitionBy("volume_id").orderBy("blob_offset", "blob_id").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.sum(F.col("size_compressed") + OVERHEAD).over(before), F.lit(0))
    return blobs.where("volume_id is not null").select("volume_id", "blob_id", "blob_offset", "size_compressed", new.alias("new_offset"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest ``order`` of each key; aggregated before the shuffle, so that a hot key is no matter."""
    return extreme(df, keys, F.max_by, order)


def earliest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return extreme(df, keys, F.min_by, order)


def extreme(df: DataFrame, keys: list[str], pick, order: str) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(pick(row, F.col(order)).alias("_row")).select("_row.*")


def dedup_assignment(uploads: DataFrame) -> DataFrame:
    """Each upload with the first upload of its content; content that many share is aggregated before it is joined."""
    firsts = uploads.groupBy("hash").agg(F.min("seq").alias("first_seq"))
    return uploads.join(firsts, "hash").select("seq", "hash", "first_seq", (F.col("seq") != F.col("first_seq")).alias("is_dedup"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the 1-based number of each row in ``order``: ranges are numbered apart and shifted by the counts before."""
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shifts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_own", own).join(F.broadcast(shifts), "_part").withColumn(name, F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")


def allocate_ids(uploads: DataFrame) -> DataFrame:
    """Uploads without a legacy id get the next ones after the greatest, in order of arrival."""
    top = uploads.agg(F.coalesce(F.max("legacy_id"), F.lit(0)).alias("_top"))
    lacking = numbered(uploads.where("legacy_id is null").select("seq"), "seq", "_n")
    return lacking.join(F.broadcast(top)).select("seq", (F.col("_top") + F.col("_n")).alias("legacy_id"))


class FirstFit:
    """The lowest volume with room: a tree of free bytes over the volumes opened so far."""

    def __init__(self, most: int, oversized: bool = False):
        self.most, self.oversized, self.size, self.free = most, oversized, 1, [most, most]
        self.opened = 0

    def place(self, need: int) -> int:
        if need > self.most:
            return self.alone() if self.oversized else -1
        while self.free[1] < need:
            self.grow()
        at = 1
        while at < self.size:
            at = 2 * at if self.free[2 * at] >= need else 2 * at + 1
        found = at - self.size
        self.take(at, need)
        return found

    def alone(self) -> int:
        """A new volume, used up at once; not even an empty record fits next to one over the limit."""
        while self.opened >= self.size:
            self.grow()
        found = self.opened
        self.take(self.size + found, self.most)
        return found

    def hold(self, at: int, used: int) -> None:
        """A volume that is in use already."""
        while at >= self.size:
            self.grow()
        self.take(self.size + at, used)

    def take(self, at: int, need: int) -> None:
        self.opened = max(self.opened, at - self.size + 1)
        self.free[at] -= need
        while at > 1:
            at //= 2
            self.free[at] = max(self.free[2 * at], self.free[2 * at + 1])

    def grow(self) -> None:
        leaves = [*self.free[self.size :], *[self.most] * self.size]
        self.size *= 2
        self.free = [0] * self.size + leaves
        for i in reversed(range(1, self.size)):
            self.free[i] = max(self.free[2 * i], self.free[2 * i + 1])


def first_fit(uploads: DataFrame, most: int, oversized: bool = False, held: DataFrame | None = None) -> DataFrame:
    """(seq, volume_id): each framed record goes to the lowest volume that holds it, else to a new one.

    A record over ``most`` gets -1, or, with ``oversized``, the next new volume to itself, as in the store. Volumes that
    hold something already are given as (volume_id, size_total).

    The fold depends on every row before, so one task streams the rows in order; it holds a number for each volume, and
    only sequence and size go to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = FirstFit(most, oversized)
        for batch in batches:
            seqs, found = [], []
            for kind, seq, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "seq", "size")), strict=True):
                if kind == 0:
                    fit.hold(seq - 1, n)
                else:
                    seqs.append(seq)
                    found.append(fit.place(n + OVERHEAD))
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array([v + 1 if v >= 0 else -1 for v in found], pa.int64())], ["seq", "volume_id"])

    rows = uploads.select(F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size"))
    if held is not None:
        rows = rows.unionAll(held.select(F.lit(0), F.col("volume_id").cast("long"), F.col("size_total").cast("long")))
    return rows.orderBy("kind", "seq").coalesce(1).mapInArrow(run, "seq bigint, volume_id bigint")
