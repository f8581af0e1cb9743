"""Shared pieces: the folder for written tables, column handling, byte-bounded slices."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnlake.session import contained, cut, drop, shared_dir, written  # noqa: F401

#: Word separators of the contracts: the space and TAB to CR.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def tidy() -> None:
    """Gives memory that a task no longer uses back: Python workers live on, and serve the stages that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows of a batch that goes to Python, where the session sets no number of its own: texts are long.
BATCH_ROWS = "1000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder; the session gets smaller batches for Python unless it has set its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c):
    """A-Z to a-z, everything else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of ``column``, one row at least, so that memory doesn't follow the batch."""
    if batch.num_rows == 0:
        return
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty: (all bytes, offsets of n + 1 int64)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with ``new`` columns after its own; own columns of the same names go."""
    keep = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *new.values()], [*keep, *new])


def schema_with(df: DataFrame, new: str) -> StructType:
    """The schema of ``df`` followed by the columns of ``new`` ("name type, ...")."""
    return StructType([*df.schema, *StructType.fromDDL(new)])


def enclosed(df: DataFrame, **own: str) -> DataFrame:
    """``df`` with the columns ``own`` under the names given, and all others in one struct ``_rest``: no name can clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in own.values()]
    chosen = [F.col(f"`{c}`").alias(n) for n, c in own.items()]
    return df.select(*chosen, *([F.struct(*rest).alias("_rest")] if rest else []))


def opened(found: DataFrame, df: DataFrame, new: tuple[str, ...], **own: str) -> DataFrame:
    """Rows that went through enclosed(): the columns of ``df``, less those that ``new`` names in any case, then ``new``."""
    names, taken = {c: n for n, c in own.items()}, {n.lower() for n in new}
    kept = [c for c in df.columns if c.lower() not in taken]
    columns = [F.col(names[c]).alias(c) if c in names else F.col("_rest").getField(c).alias(c) for c in kept]
    return found.select(*columns, *new)


def whole_ids(df: DataFrame, key: str) -> None:
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{key}: ids are whole numbers")


def spans_of(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, texts' first spans) of the maximal runs of true bytes; none crosses from a text into the next.

    The third has n + 1 entries: spans of text i are those from entry i up to entry i + 1.
    """
    full = off[:-1] < off[1:]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    heads = off[:-1][full]
    begins[heads] = mask[heads]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    tails = off[1:][full] - 1
    ends[tails] = mask[tails]
    at = np.flatnonzero(begins)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, off)


def packed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The spans of ``data`` as a binary array; spans lie in order and don't overlap."""
    step = np.zeros(len(data) + 1, np.int8)
    step[begins] += 1
    np.subtract.at(step, ends, 1)
    kept = np.ascontiguousarray(data[np.cumsum(step[:-1], dtype=np.int8) > 0])
    starts = np.concatenate([[0], np.cumsum(ends - begins)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(starts), pa.py_buffer(kept)])


#: Byte classes of the contracts: words between white space, and words of letters and digits.
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
