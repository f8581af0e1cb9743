"""Volumes, indexes and logs as Spark tables: data sources that read one file a partition, checked reads, and writers.

Writers write under a name of the attempt and rename when the file is whole: a task that is lost or runs twice leaves no
torn file.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnlake.operators.ordered import compaction_plan
from cairnlake.schema import ALGORITHMS, HEADER, INDEX_RECORD, MAGIC, OVERHEAD
from cairnlake.sources import formats

SCHEMAS = {
    "volume": "volume_id bigint, blob_id bigint, offset bigint, size bigint, algorithm string, payload binary, crc_ok boolean",
    "index": "volume_id bigint, blob_id bigint, offset bigint, size bigint, algorithm string, crc bigint",
    "entries": "volume_id bigint, blob_id bigint, offset bigint, size bigint, algorithm string, found_in string",
    "files": "volume_id bigint, name string, bytes bigint",
    "log": "seq bigint, file_id string, blob_id bigint, created_ns bigint, legacy_id bigint, expires_ns bigint, tags string, name string",
}
DATA = r"volume_0*(\d+)\.dat$"
FILES = {"volume": DATA, "index": r"volume_0*(\d+)\.meta$", "entries": DATA, "files": DATA, "log": r"(files_metadata)\.bin$"}


def filesystem(folder: str):
    """(file system, path in it) of a local path or a URI that Arrow can open."""
    from pyarrow import fs

    if urlparse(folder).scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(urlparse(folder).path)
    return fs.FileSystem.from_uri(folder)


def exists(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type == fs.FileType.File


def volume_path(system, folder: str, volume: int, end: str = "dat") -> str:
    """The file of a volume: of its padded name, or of the plain one if only that is there."""
    padded, plain = f"{folder}/volume_{volume:08d}.{end}", f"{folder}/volume_{volume}.{end}"
    return plain if not exists(system, padded) and exists(system, plain) else padded


class Replaced:
    """A file that is written under another name and takes its own when it is whole."""

    def __init__(self, system, path: str):
        self.system, self.path, self.draft = system, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out = system.open_output_stream(self.draft)

    def write(self, raw: bytes) -> None:
        self.out.write(raw)

    def copy(self, size: int) -> None:
        """The first ``size`` bytes of what the file held before."""
        with self.system.open_input_stream(self.path) as f:
            while size and (raw := f.read(min(size, 1 << 22))):
                self.out.write(raw)
                size -= len(raw)
        if size:
            raise OSError(f"{self.path} is shorter than its accounts say")

    def close(self) -> None:
        self.out.close()
        self.system.move(self.draft, self.path)


class Reader(DataSourceReader):
    def __init__(self, kind: str, folder: str):
        self.kind, self.folder = kind, folder

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = filesystem(self.folder)
        found = [x.path for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if re.search(FILES[self.kind], x.path)]
        return [InputPartition(p) for p in sorted(found)] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        system, _ = filesystem(self.folder)
        volume = re.search(FILES[self.kind], partition.value)[1]
        if self.kind == "files":
            yield int(volume), os.path.basename(partition.value), system.get_file_info(partition.value).size
            return
        if self.kind == "entries":
            yield from ((int(volume), *r) for r in entries(system, partition.value))
            return
        with system.open_input_stream(partition.value) as f:
            if self.kind == "log":
                yield from ((k, *r) for k, r in enumerate(formats.log_in(f)))
                return
            rows = formats.blobs_in(f) if self.kind == "volume" else formats.index_in(f)
            for blob_id, offset, size, algorithm, *rest in rows:
                yield (int(volume), blob_id, offset, size, formats.NAMES.get(algorithm, "unknown"), *rest)


def entries(system, path: str) -> Iterator[tuple]:
    """(blob_id, offset, size, algorithm, found_in) of a volume: from its index, or from its data where that is missing, torn or points outside."""
    index, held = re.sub(r"dat$", "meta", path), system.get_file_info(path).size
    if exists(system, index):
        with system.open_input_stream(index) as f:
            raw = f.read()
        rows = [formats.INDEX.unpack_from(raw, k) for k in range(0, len(raw) - INDEX_RECORD + 1, INDEX_RECORD)]
        if len(raw) % INDEX_RECORD == 0 and all(offset + size + OVERHEAD <= held for _, offset, size, _, _ in rows):
            yield from ((b, offset, size, formats.NAMES.get(a, "unknown"), "index") for b, offset, size, a, _ in rows)
            return
    with system.open_input_stream(path) as f:
        yield from ((b, offset, size, formats.NAMES.get(a, "unknown"), "data") for b, offset, size, a, _, _ in formats.blobs_in(f))


class Records(DataSource):
    """``spark.read.format("records").option("kind", "volume").load(folder)``; kinds: volume, index, entries, files, log."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["kind"], self.options["path"])


def read_records(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    spark.dataSource.register(Records)
    return spark.read.format("records").option("kind", kind).load(folder)


CHECKS = ("in_folder", "in_file", "magic_ok", "size_ok", "id_ok", "crc_ok")


def read_blobs(blobs: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """(blob_id, volume_id, a column per check, readable[, payload]) of blobs at (volume_id, blob_offset, size_compressed).

    A check is null where one before it failed. Rows of a volume are read in the order of their offsets by the tasks that
    they are ranged into, so a large volume is read by several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        volume, f, held = None, None, 0
        for batch in batches:
            out = []
            for v, blob, offset, size in zip(*(batch.column(c).to_pylist() for c in ("volume_id", "blob_id", "blob_offset", "size_compressed")), strict=True):
                if v != volume:
                    if f is not None:
                        f.close()
                    name = volume_path(system, path, v)
                    volume, f = v, (system.open_input_file(name) if exists(system, name) else None)
                    held = f.size() if f is not None else 0
                out.append((blob, v, *checks(f, held, blob, offset, size)))
            columns = [*zip(*out, strict=True)] or [[]] * (len(CHECKS) + 3)
            types = [pa.int64(), pa.int64(), *[pa.bool_()] * len(CHECKS), pa.binary()]
            found = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["blob_id", "volume_id", *CHECKS, "payload"])
            yield found if payload else found.drop_columns(["payload"])
        if f is not None:
            f.close()

    rows = blobs.select("volume_id", "blob_id", "blob_offset", "size_compressed").repartitionByRange("volume_id", "blob_offset").sortWithinPartitions("volume_id", "blob_offset")
    schema = "blob_id bigint, volume_id bigint, " + ", ".join(f"{c} boolean" for c in CHECKS) + (", payload binary" if payload else "")
    return rows.mapInArrow(run, schema).withColumn("readable", F.coalesce(F.col(CHECKS[-1]), F.lit(False)) & F.coalesce("id_ok", F.lit(False)))


def checks(f, held: int, blob: int, offset: int, size: int) -> tuple:
    """The outcome of each check, then the payload if all went well."""
    if f is None:
        return (False, *[None] * len(CHECKS))
    if offset < 0 or offset + OVERHEAD + size > held:
        return (True, False, *[None] * (len(CHECKS) - 1))
    f.seek(offset)
    raw = f.read(OVERHEAD + size)
    magic, _, _, stored, own = formats.BLOB.unpack_from(raw)
    if magic != MAGIC:
        return (True, True, False, *[None] * (len(CHECKS) - 2))
    if stored != size:
        return (True, True, True, False, *[None] * (len(CHECKS) - 3))
    payload = raw[HEADER : HEADER + size]
    ok = int.from_bytes(raw[HEADER + size :], "big") == zlib.crc32(payload)
    return (True, True, True, True, own == blob, ok, payload if ok and own == blob else None)


class VolumeWriter:
    """Writes volumes one after another, each with its index; ``start`` bytes of a volume that is there already stay."""

    def __init__(self, folder: str):
        self.system, self.folder = filesystem(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.volume, self.done = None, []

    def open(self, volume: int, start: int) -> None:
        self.close()
        self.volume, self.at, self.n, self.start = volume, start, 0, start
        self.data, self.index = (Replaced(self.system, volume_path(self.system, self.folder, volume, end)) for end in ("dat", "meta"))
        if start:
            self.data.copy(start)
            with self.system.open_input_stream(self.index.path) as f:
                for entry in formats.index_in(f):
                    if entry[1] < start:
                        self.index.write(formats.INDEX.pack(*entry))

    def add(self, blob: int, algorithm: int, payload: bytes) -> int:
        record, at = formats.blob_record(blob, algorithm, payload), self.at
        self.data.write(record)
        self.index.write(formats.index_record(blob, at, len(payload), algorithm, int.from_bytes(record[-4:], "big")))
        self.at, self.n = at + len(record), self.n + 1
        return at

    def close(self) -> None:
        if self.volume is not None:
            self.data.close()
            self.index.close()
            self.done.append((self.volume, self.n, self.at - self.start))
        self.volume = None

    def accounts(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*self.done, strict=True) if self.done else ([], [], []))], ["volume_id", "records", "bytes"])


ACCOUNTS = "volume_id bigint, records bigint, bytes bigint"


def write_volumes(blobs: DataFrame, folder: str, held: DataFrame | None = None) -> DataFrame:
    """Writes (volume_id, blob_id, algorithm, payload) as volumes with indexes; returns (volume_id, records, bytes) added.

    Volumes given in ``held`` (volume_id, size_total) are appended to, behind the bytes that their accounts know; what a
    lost attempt left beyond is overwritten. A task streams the sorted records of its volumes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = VolumeWriter(folder)
        for batch in batches:
            for v, start, b, a, p in zip(*(batch.column(c).to_pylist() for c in ("volume_id", "start", "blob_id", "algorithm", "payload")), strict=True):
                if v != out.volume:
                    out.open(v, start)
                out.add(b, ALGORITHMS[a], p)
        yield out.accounts()

    rows = blobs.select("volume_id", "blob_id", "algorithm", "payload")
    starts = rows.withColumn("start", F.lit(0).cast("long")) if held is None else rows.join(held.select("volume_id", F.col("size_total").cast("long").alias("start")), "volume_id", "left").fillna(0, "start")
    dealt = starts.repartition("volume_id").sortWithinPartitions("volume_id", "blob_id")
    return dealt.mapInArrow(run, ACCOUNTS)


def compact_volumes(blobs: DataFrame, folder: str) -> DataFrame:
    """Rewrites the volumes of the catalogued ``blobs`` without what lies between; (volume_id, blob_id, new_offset).

    Each record is checked and copied in the order of the old offsets; data and index take their places when both are
    whole. A damaged record ends the job, and the volume stays as it was.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, f, rows = VolumeWriter(folder), None, []
        for batch in batches:
            for v, b, offset, size in zip(*(batch.column(c).to_pylist() for c in ("volume_id", "blob_id", "blob_offset", "size_compressed")), strict=True):
                if v != out.volume:
                    f = out.system.open_input_file(volume_path(out.system, out.folder, v))
                    out.open(v, 0)
                *_, payload = checks(f, f.size(), b, offset, size)
                if payload is None:
                    raise OSError(f"volume {v}: no record of blob {b} at {offset}")
                f.seek(offset)
                rows.append((v, b, out.add(b, formats.BLOB.unpack(f.read(HEADER))[2], payload)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], ["volume_id", "blob_id", "new_offset"])

    planned = compaction_plan(blobs).select("volume_id", "blob_id", "blob_offset", "size_compressed")
    dealt = planned.repartition("volume_id").sortWithinPartitions("volume_id", "blob_offset", "blob_id")
    return dealt.mapInArrow(run, "volume_id bigint, blob_id bigint, new_offset bigint")


def write_indexes(blobs: DataFrame, folder: str) -> DataFrame:
    """Writes the indexes of the catalogued blobs anew, with checksums of the data as it is; (volume_id, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        volume, f, out, n, done = None, None, None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                f.close()
                done.append((volume, n, n * INDEX_RECORD))

        for batch in batches:
            for v, b, offset, size in zip(*(batch.column(c).to_pylist() for c in ("volume_id", "blob_id", "blob_offset", "size_compressed")), strict=True):
                if v != volume:
                    close()
                    volume, n, f, out = v, 0, system.open_input_file(volume_path(system, path, v)), Replaced(system, volume_path(system, path, v, "meta"))
                f.seek(offset)
                raw = f.read(HEADER + size)
                out.write(formats.index_record(b, offset, size, formats.BLOB.unpack_from(raw)[2], zlib.crc32(raw[HEADER:])))
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*done, strict=True) if done else ([], [], []))], ["volume_id", "records", "bytes"])

    rows = blobs.where("volume_id is not null").select("volume_id", "blob_id", "blob_offset", "size_compressed").repartition("volume_id").sortWithinPartitions("volume_id", "blob_offset")
    return rows.mapInArrow(run, ACCOUNTS)


def write_log(files: DataFrame, folder: str, append: bool = False) -> None:
    """Writes the recovery log of (seq, file_id, blob_id, created_at, legacy_id, expires_at, tags, name) in order, or adds to it.

    A log is one file in one order, so one task streams it.
    """
    nanos = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) * 1000).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        n, name = 0, f"{path}/files_metadata.bin"
        out = Replaced(system, name)
        if append and exists(system, name):
            out.copy(system.get_file_info(name).size)
        for batch in batches:
            for r in batch.to_pylist():
                out.write(formats.log_record(r["file_id"], r["blob_id"], r["created_at"], r["legacy_id"], r["expires_at"], r["tags"], r["name"]))
                n += 1
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = files.select("seq", "file_id", "blob_id", nanos("created_at"), "legacy_id", nanos("expires_at"), "tags", "name")
    rows.orderBy("seq").coalesce(1).mapInArrow(run, "n bigint").collect()


def write_files(files: DataFrame, folder: str, algorithm: str) -> None:
    """Writes (path, content) as packed files below the folder, each under a draft name first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
                out = Replaced(system, f"{top}/{path}")
                out.write(formats.packed(content, algorithm))
                out.close()
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files.select("path", "content").mapInArrow(run, "n bigint").collect()


def read_packed(wanted: DataFrame, folder: str, path: str) -> DataFrame:
    """``wanted`` with ``content``: the unpacked bz2 file at the column ``path`` below the folder; null where there is none."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: contents can be long
                one = batch.slice(k, 1)
                name, content = one.column(path)[0].as_py(), None
                if name is not None and exists(system, f"{top}/{name}"):
                    with system.open_input_stream(f"{top}/{name}", compression=None) as f:
                        content = formats.unpacked(f.read(), "bz2")
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([content], pa.binary())], [*one.schema.names, "content"])

    return wanted.mapInArrow(run, StructType([*wanted.schema, StructField("content", BinaryType())]))
