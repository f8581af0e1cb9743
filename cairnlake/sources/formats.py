"""The binary records: blobs in volumes, index entries, recovery log; and the codecs of payloads. All numbers are big-endian."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.schema import ALGORITHMS, FOOTER, HEADER, INDEX_RECORD, MAGIC, VERSION

BLOB, INDEX = struct.Struct(">IBBQQ"), struct.Struct(">QQQBI")
NAMES = {v: k for k, v in ALGORITHMS.items()}


def blob_record(blob_id: int, algorithm: int, payload: bytes) -> bytes:
    return BLOB.pack(MAGIC, VERSION, algorithm, len(payload), blob_id) + payload + struct.pack(">I", zlib.crc32(payload))


def index_record(blob_id: int, offset: int, size: int, algorithm: int, crc: int) -> bytes:
    return INDEX.pack(blob_id, offset, size, algorithm, crc)


def log_record(file_id: str, blob_id: int, created_ns: int, legacy_id: int | None, expires_ns: int | None, tags: str, name: str) -> bytes:
    short = lambda s: struct.pack(">H", len(s.encode())) + s.encode()
    flags = (legacy_id is not None) | (expires_ns is not None) << 1 | bool(tags) << 2
    body = short(file_id) + struct.pack(">QQB", blob_id, created_ns, flags)
    body += struct.pack(">Q", legacy_id) if legacy_id is not None else b""
    body += struct.pack(">Q", expires_ns) if expires_ns is not None else b""
    body += short(tags) if tags else b""
    body += short(name)
    return struct.pack(">I", len(body)) + body


def blobs_in(f: BinaryIO) -> Iterator[tuple]:
    """(blob_id, offset, size, algorithm, payload, crc_ok) of each record, up to the end or the first that isn't one."""
    at = 0
    while len(head := f.read(HEADER)) == HEADER:
        magic, _, algorithm, size, blob_id = BLOB.unpack(head)
        if magic != MAGIC:
            return
        payload, tail = f.read(size), f.read(FOOTER)
        if len(payload) < size or len(tail) < FOOTER:
            return
        yield blob_id, at, size, algorithm, payload, struct.unpack(">I", tail)[0] == zlib.crc32(payload)
        at += HEADER + size + FOOTER


def index_in(f: BinaryIO) -> Iterator[tuple]:
    """(blob_id, offset, size, algorithm, crc) of each whole entry."""
    while len(raw := f.read(INDEX_RECORD)) == INDEX_RECORD:
        yield INDEX.unpack(raw)


def log_in(f: BinaryIO) -> Iterator[tuple]:
    """(file_id, blob_id, created_ns, legacy_id, expires_ns, tags, name) of each whole record."""
    while len(raw := f.read(4)) == 4:
        body = f.read(struct.unpack(">I", raw)[0])
        if len(body) < struct.unpack(">I", raw)[0]:
            return
        b = io.BytesIO(body)
        number = lambda: struct.unpack(">Q", b.read(8))[0]  # noqa: B023, E731
        short = lambda: b.read(struct.unpack(">H", b.read(2))[0]).decode()  # noqa: B023, E731
        file_id, blob_id, created, flags = short(), number(), number(), b.read(1)[0]
        legacy = number() if flags & 1 else None
        expires = number() if flags & 2 else None
        tags = short() if flags & 4 else ""
        yield file_id, blob_id, created, legacy, expires, tags, short()


def packed(payload: bytes, algorithm: str) -> bytes:
    if algorithm == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(payload)
    return {"gzip": lambda x: gzip.compress(x, mtime=0), "bz2": bz2.compress, "none": lambda x: x}[algorithm](payload)


def unpacked(payload: bytes, algorithm: str) -> bytes:
    if algorithm == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(payload)
    return {"gzip": gzip.decompress, "bz2": bz2.decompress, "none": lambda x: x}[algorithm](payload)


def processed(content: Column, algorithm: str, hasher: str = "blake2b") -> Column:
    """One pass over each content: a struct of its hash, its raw size and the packed bytes."""
    new = {"blake2b": lambda: hashlib.blake2b(digest_size=32), "sha256": hashlib.sha256}[hasher]

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            if x is None:
                rows.append((None, None, None))
                continue
            h = new()
            h.update(x)
            rows.append((h.hexdigest(), len(x), packed(x, algorithm)))
        return pd.DataFrame(rows, columns=["hash", "size_raw", "packed"])

    return F.pandas_udf(run, "hash string, size_raw bigint, packed binary")(content)


def blake2b(content: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(x, digest_size=32).hexdigest())

    return F.pandas_udf(run, "string")(content)


def pack(content: Column, algorithm: Column) -> Column:
    def run(c: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else packed(x, y) for x, y in zip(c, a, strict=True)])

    return F.pandas_udf(run, "binary")(content, algorithm)


def unpack(content: Column, algorithm: Column) -> Column:
    def run(c: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unpacked(x, y) for x, y in zip(c, a, strict=True)])

    return F.pandas_udf(run, "binary")(content, algorithm)


def unsigned(raw: Column, first: int, size: int) -> Column:
    """A big-endian number of a binary column, from its 1-based first byte."""
    return F.conv(F.hex(F.substring(raw, first, size)), 16, -10).cast("bigint")
