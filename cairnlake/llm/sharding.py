"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table (an offset and a step); shards take turns
to claim their next free slot until all are claimed. A key's slot is its hash modulo the prime, so placement is one
look-up in a table that is broadcast: its size is ``SLOTS`` rows, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import enclosed, opened, read

#: A prime, at least a hundred times the number of shards; and the most that a table may have.
SLOTS, MOST_SLOTS = 65_537, 1 << 20
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def number(text: Column, first: int) -> Column:
    """Eight hexadecimal digits of the MD5 of a text as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 8), 16, 10).cast("long")


def claimed(offsets: Sequence[int], steps: Sequence[int], slots: int) -> list[int]:
    """The shard of each slot: shards claim in turn, each its next preferred free slot."""
    table, at, left = [-1] * slots, list(offsets), slots
    while left:
        for shard, step in enumerate(steps):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step) % slots
            table[at[shard]] = shard
            left -= 1
            if not left:
                break
    return table


def table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table. ``slots`` must be a prime of at most ``MOST_SLOTS``; names must differ."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or slots > MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards need names of their own and a prime table that holds them")
    names = sorted(shards)
    got = spark.createDataFrame([(n,) for n in names], "shard string").select("shard", (number(F.col("shard"), 1) % slots).alias("offset"), (number(F.col("shard"), 9) % (slots - 1) + 1).alias("step")).collect()
    by = {r["shard"]: r for r in got}
    filled = claimed([by[n]["offset"] for n in names], [by[n]["step"] for n in names], slots)
    return spark.createDataFrame([(k, names[s]) for k, s in enumerate(filled)], "slot long, shard string")


def placed(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of the column ``key``, read as text; a null key counts as an empty text.

    Equal keys go to one shard, so a key of many rows wants a finer key (such as the row's id). Long keys are hashed whole;
    repeated rows keep their rows; own columns ``slot`` and ``shard``, in any case, are replaced; an empty table stays
    empty.
    """
    keyed = enclosed(df, _key=key).withColumn("slot", number(F.coalesce(F.col("_key").cast("string"), F.lit("")), 1) % slots)
    return opened(keyed.join(F.broadcast(table(df.sparkSession, shards, slots)), "slot"), df, ("slot", "shard"), _key=key)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document, by its id."""
    return placed(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
