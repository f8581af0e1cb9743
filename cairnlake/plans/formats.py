"""Queries of the binary formats and codecs; SQL has no codecs, so most are held by round trips in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import text
from cairnlake.operators import recovery
from cairnlake.plans.fixtures import Lake
from cairnlake.plans.registry import query
from cairnlake.schema import OVERHEAD
from cairnlake.session import cut, shared_dir
from cairnlake.sources import formats, volumes


def payloads(lake: Lake) -> DataFrame:
    """The blobs that have a place, with their packed contents."""
    texts = lake.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.first("text").alias("text"))
    placed = lake.blob_all.where("volume_id is not null").join(texts, "hash")
    algorithm = F.col("compression_alg")
    return placed.select("volume_id", "blob_id", algorithm.alias("algorithm"), formats.pack(F.col("text").cast("binary"), algorithm).alias("payload"))


def written(lake: Lake) -> str:
    """A folder with the volumes, indexes and log of the catalog."""
    folder = f"{shared_dir(lake.spark)}/volumes-{uuid.uuid4().hex}"
    volumes.write_volumes(payloads(lake), folder).collect()
    volumes.write_log(lake.replay_log.where("blob_id > 0"), folder)
    return folder


@query()
def blake2b_content(lake: Lake) -> DataFrame:
    return lake.documents.select("doc_id", formats.blake2b(F.col("text").cast("binary")).alias("hash"))


@query("SELECT doc_id, true AS same FROM documents", fixtures=False)
def codec_roundtrip(lake: Lake) -> DataFrame:
    raw = F.col("text").cast("binary")
    algorithm = F.element_at(F.array(*map(F.lit, ("none", "gzip", "zstd"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = lake.documents.select("doc_id", raw.alias("raw"), algorithm.alias("a")).withColumn("p", formats.pack(F.col("raw"), F.col("a")))
    return rows.select("doc_id", (formats.unpack(F.col("p"), F.col("a")) == F.col("raw")).alias("same"))


@query("SELECT volume_id, blob_id, true AS crc_ok FROM blob_all WHERE volume_id IS NOT NULL")
def volume_scan(lake: Lake) -> DataFrame:
    return volumes.read_records(lake.spark, "volume", written(lake)).select("volume_id", "blob_id", "crc_ok")


@query("SELECT volume_id, blob_id, compression_alg AS algorithm FROM blob_all WHERE volume_id IS NOT NULL")
def index_scan(lake: Lake) -> DataFrame:
    return volumes.read_records(lake.spark, "index", written(lake)).select("volume_id", "blob_id", "algorithm")


@query("SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, file_id, blob_id, legacy_id, tags, name FROM replay_log WHERE blob_id > 0")
def log_scan(lake: Lake) -> DataFrame:
    return volumes.read_records(lake.spark, "log", written(lake)).select("seq", "file_id", "blob_id", "legacy_id", "tags", "name")


def placed(lake: Lake, folder: str) -> DataFrame:
    """The catalogued blobs with the offsets and sizes that their volumes were written with."""
    index = volumes.read_records(lake.spark, "index", folder).select("blob_id", F.col("offset").alias("blob_offset"), F.col("size").alias("size_compressed"))
    return lake.blobs.drop("blob_offset", "size_compressed").join(index, "blob_id", "left")


@query("""SELECT count(*) FILTER (WHERE state = 'committed') AS checked, 0::BIGINT AS unreadable, count(*) FILTER (WHERE state = 'pending') AS pending, 0::BIGINT AS missing_volumes,
(SELECT count(*) FROM blobs ANTI JOIN files USING (blob_id)) AS orphan_blobs, (SELECT count(*) FROM files ANTI JOIN blobs USING (blob_id)) AS missing_blobs,
CASE WHEN (SELECT count(*) FROM files ANTI JOIN blobs USING (blob_id)) > 0 THEN 'error' ELSE 'warning' END AS status FROM blobs""")
def deep_integrity(lake: Lake) -> DataFrame:
    """The catalog against the records on disk: every committed blob is read and checked."""
    folder = written(lake)
    return recovery.deep_integrity(placed(lake, folder), lake.files, folder)


@query("""SELECT blob_id, volume_id, true AS in_folder, b % 7 <> 1 AS in_file, CASE WHEN b % 7 <> 1 THEN b % 7 <> 2 END AS magic_ok, CASE WHEN b % 7 NOT IN (1, 2) THEN b % 7 <> 3 END AS size_ok, CASE WHEN b % 7 NOT IN (1, 2, 3) THEN true END AS crc_ok
FROM (SELECT *, blob_id AS b FROM blobs WHERE state = 'committed')""")
def blob_checks(lake: Lake) -> DataFrame:
    """Reads at places of which some are made wrong: beyond the file, off the record, of another size."""
    folder = written(lake)
    b = F.col("blob_id") % 7
    off = F.when(b == 1, F.lit(1 << 40)).when(b == 2, F.col("blob_offset") + 1).otherwise(F.col("blob_offset"))
    size = F.when(b == 2, F.greatest(F.col("size_compressed") - 1, F.lit(0))).when(b == 3, F.greatest(F.col("size_compressed") - 1, F.lit(0))).otherwise(F.col("size_compressed"))
    rows = placed(lake, folder).where("state = 'committed'").withColumn("blob_offset", off).withColumn("size_compressed", size)
    return volumes.read_blobs(rows, folder).select("blob_id", "volume_id", "in_folder", "in_file", "magic_ok", "size_ok", "crc_ok")


@query("SELECT volume_id, blob_id, CASE WHEN volume_id % 3 = 0 THEN 'data' ELSE 'index' END AS found_in FROM blob_all WHERE volume_id IS NOT NULL")
def index_first_scan(lake: Lake) -> DataFrame:
    """Volumes by their index; those whose index is lost or torn by their data."""
    folder = written(lake)
    system, path = volumes.filesystem(folder)
    for v in (3, 6):
        name = f"{path}/volume_{v:08d}.meta"
        if volumes.exists(system, name):
            if v == 3:
                system.delete_file(name)
            else:
                with system.open_output_stream(name) as f:
                    f.write(b"torn")
    return volumes.read_records(lake.spark, "entries", folder).select("volume_id", "blob_id", "found_in")


@query("SELECT volume_id, count(*) AS records, count(*) * 29 AS bytes FROM blobs WHERE volume_id IS NOT NULL GROUP BY 1")
def index_rewrite(lake: Lake) -> DataFrame:
    """Indexes of the catalogued blobs, written anew from the data."""
    folder = written(lake)
    volumes.write_indexes(placed(lake, folder), folder).collect()
    found = volumes.read_records(lake.spark, "index", folder).join(volumes.read_records(lake.spark, "volume", folder).where("crc_ok").select("blob_id", "volume_id", "offset", F.crc32("payload").alias("crc")), ["blob_id", "volume_id", "offset", "crc"])
    return found.groupBy("volume_id").agg(F.count("*").alias("records"), (F.count("*") * 29).alias("bytes"))


@query("SELECT volume_id, count(*) AS records, true AS all_readable, true AS as_planned FROM blobs WHERE volume_id IS NOT NULL GROUP BY 1")
def compacted_volumes(lake: Lake) -> DataFrame:
    """Volumes rewritten without the dropped blobs, read back at their new offsets."""
    folder = written(lake)
    blobs = placed(lake, folder).where("volume_id is not null")
    moved = cut(volumes.compact_volumes(blobs, folder))
    now = blobs.drop("blob_offset").join(moved.select("blob_id", F.col("new_offset").alias("blob_offset")), "blob_id")
    read = volumes.read_blobs(now, folder).groupBy("volume_id").agg(F.count("*").alias("records"), F.every("readable").alias("all_readable"))
    size = volumes.read_records(lake.spark, "files", folder).select("volume_id", "bytes")
    planned = now.groupBy("volume_id").agg(F.sum(F.col("size_compressed") + OVERHEAD).alias("_bytes"))
    return read.join(size, "volume_id").join(planned, "volume_id").select("volume_id", "records", "all_readable", (F.col("bytes") == F.col("_bytes")).alias("as_planned"))


@query("SELECT volume_id, count(*) AS records, true AS crc_ok FROM blob_all WHERE volume_id IS NOT NULL GROUP BY 1")
def volume_append(lake: Lake) -> DataFrame:
    """Volumes written in two batches, the second behind the bytes of the first."""
    folder, rows = f"{shared_dir(lake.spark)}/volumes-{uuid.uuid4().hex}", payloads(lake)
    sizes = cut(volumes.write_volumes(rows.where("blob_id % 2 = 0"), folder)).select("volume_id", F.col("bytes").alias("size_total"))
    volumes.write_volumes(rows.where("blob_id % 2 = 1"), folder, sizes).collect()
    return volumes.read_records(lake.spark, "volume", folder).groupBy("volume_id").agg(F.count("*").alias("records"), F.every("crc_ok").alias("crc_ok"))


@query("SELECT count(*) AS records, count(DISTINCT file_id) AS files, max(seq) - max(seq) + count(*) - 1 AS last_seq FROM replay_log WHERE blob_id > 0")
def log_append(lake: Lake) -> DataFrame:
    """A log written in two batches."""
    folder, rows = f"{shared_dir(lake.spark)}/volumes-{uuid.uuid4().hex}", lake.replay_log.where("blob_id > 0")
    volumes.write_log(rows.where("seq < 1000000"), folder)
    volumes.write_log(rows.where("seq >= 1000000"), folder, True)
    return volumes.read_records(lake.spark, "log", folder).agg(F.count("*").alias("records"), F.countDistinct("file_id").alias("files"), F.max("seq").alias("last_seq"))


def listing(lake: Lake) -> DataFrame:
    """The volume files of a folder from which some are gone, one under its plain name."""
    folder = written(lake)
    system, path = volumes.filesystem(folder)
    for v in (3, 6):
        if volumes.exists(system, f"{path}/volume_{v:08d}.dat"):
            system.delete_file(f"{path}/volume_{v:08d}.dat")
    if volumes.exists(system, f"{path}/volume_00000002.dat"):
        system.move(f"{path}/volume_00000002.dat", f"{path}/volume_2.dat")
    return volumes.read_records(lake.spark, "files", folder)


@query("SELECT i AS volume_id, CASE WHEN volume_id IS NULL OR volume_id % 3 = 0 THEN 'MISSING' ELSE 'OK' END AS status FROM generate_series(1, 12) AS s(i) LEFT JOIN volumes ON volume_id = i")
def volume_files_status(lake: Lake) -> DataFrame:
    """Volumes against the files that a listing of the folder finds."""
    found = listing(lake).select("volume_id", F.lit("OK").alias("found"))
    return lake.spark.range(1, 13).select(F.col("id").alias("volume_id")).join(found, "volume_id", "left").select("volume_id", F.coalesce("found", F.lit("MISSING")).alias("status"))


@query("SELECT DISTINCT b.volume_id FROM blobs b WHERE b.volume_id IS NOT NULL AND b.volume_id NOT IN (SELECT volume_id FROM volumes WHERE volume_id % 3 <> 0)")
def volumes_missing_on_disk(lake: Lake) -> DataFrame:
    return recovery.missing_volumes(lake.blobs, listing(lake))


@query("SELECT max(volume_id) AS volume_id, count(*) AS volumes FROM volumes WHERE volume_id % 3 <> 0")
def highest_volume(lake: Lake) -> DataFrame:
    """The volume that goes on being written: the greatest number that a file has."""
    return listing(lake).agg(F.max("volume_id").alias("volume_id"), F.count("*").alias("volumes"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN sha256(text) END AS hash, split_part(lang || '/' || source, '/', 2) AS base FROM documents WHERE doc_id % 5 = 1", fixtures=False)
def packed_sources(lake: Lake) -> DataFrame:
    """Source files, unpacked from their places by number; null where a file is missing. Bases of their names."""
    folder = f"{shared_dir(lake.spark)}/sources-{uuid.uuid4().hex}"
    rows = lake.documents.where("doc_id % 5 = 1").select("doc_id", "text", text.basename(F.concat("lang", F.lit("/"), "source")).alias("base"), text.legacy_path(F.col("doc_id")).alias("path"))
    volumes.write_files(rows.where("doc_id % 9 <> 4").select("path", F.col("text").cast("binary").alias("content")), folder, "bz2")
    return volumes.read_packed(rows.select("doc_id", "base", "path"), folder, "path").select("doc_id", F.sha2("content", 256).alias("hash"), "base")


@query("SELECT blob_id, blob_id % 65536 AS u16, blob_id * 65537 % 4294967296 AS u32, blob_id * 4294967 AS u64 FROM blobs")
def big_endian(lake: Lake) -> DataFrame:
    """Unsigned numbers of two, four and eight bytes, from their binary form."""
    b = F.col("blob_id")
    raw = lambda c, digits: F.unhex(F.lpad(F.hex(c), digits, "0"))
    joined = lake.blobs.select("blob_id", F.concat(raw(b % 65536, 4), raw(b * 65537 % 4294967296, 8), raw(b * 4294967, 16)).alias("raw"))
    return joined.select("blob_id", *[formats.unsigned(F.col("raw"), at, n).alias(name) for name, at, n in (("u16", 1, 2), ("u32", 3, 4), ("u64", 7, 8))])


@query("SELECT blob_id, volume_id, hash, size_raw, compression_alg FROM blob_all WHERE volume_id IS NOT NULL")
def rebuild_blobs(lake: Lake) -> DataFrame:
    folder = written(lake)
    blobs = recovery.rebuilt(volumes.read_records(lake.spark, "volume", folder), volumes.read_records(lake.spark, "log", folder))[0]
    return blobs.select("blob_id", "volume_id", "hash", "size_raw", "compression_alg")


@query("""SELECT file_id, blob_id, name, tags FROM (SELECT * FROM replay_log WHERE blob_id > 0 QUALIFY row_number() OVER (PARTITION BY blob_id, name ORDER BY seq DESC) = 1)
WHERE blob_id IN (SELECT blob_id FROM blob_all WHERE volume_id IS NOT NULL)""")
def rebuild_files(lake: Lake) -> DataFrame:
    folder = written(lake)
    return recovery.rebuilt(volumes.read_records(lake.spark, "volume", folder), volumes.read_records(lake.spark, "log", folder))[1].select("file_id", "blob_id", "name", "tags")


@query("SELECT file_id, b.hash FROM replay_log r JOIN blob_all b ON r.blob_id = b.blob_id WHERE b.volume_id IS NOT NULL")
def recover_files(lake: Lake) -> DataFrame:
    folder = written(lake)
    found = recovery.recovered(volumes.read_records(lake.spark, "volume", folder), volumes.read_records(lake.spark, "log", folder))
    return found.select("file_id", F.sha2("content", 256).alias("hash"))
