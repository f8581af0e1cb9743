"""Whole chains: uploads into volumes and back, lost attempts, damaged records, jobs on a timer, JDBC ranges."""

import bz2
import os
import subprocess
import sys
import time
import uuid
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from cairnlake import schema
from cairnlake.engine import Engine
from cairnlake.operators import migration
from cairnlake.sources import formats, jdbc, volumes
from cairnlake.streaming import schedule

NOW = "2024-05-01 00:00:00"
TYPES = [(1, "text/plain", "text", "plain")]


def requests(spark, rows):
    return spark.createDataFrame([(f"r{i}", i, name, bytearray(body), "", legacy, validity, tags) for i, (name, body, legacy, validity, tags) in enumerate(rows)], "request_id string, seq bigint, name string, content binary, content_type string, legacy_id bigint, validity string, tags string")


def empty(spark, folder):
    return Engine(spark.createDataFrame([], schema.FILES), spark.createDataFrame([], schema.BLOBS), spark.createDataFrame([], "volume_id bigint, size_total bigint, size_deleted bigint"), spark.createDataFrame(TYPES, schema.FILE_TYPES), folder)


def test_uploads_and_back(spark, tmp_path):
    big, small = b"abc " * 3000, b"x"
    rows = [("a.txt", big, None, "", ""), ("a.txt", big, None, "", "b, a"), ("b.txt", big, 7, "2 days", "t"), ("b.txt", big, 7, "2 days", "u"), ("c.txt", small, 7, "", ""), ("c.txt", small, None, "never", ""), ("d.txt", small, None, "1 month", ""), ("e.txt", b"y" * 300, None, "", "")]
    engine = empty(spark, str(tmp_path))
    done = engine.upload(requests(spark, rows), NOW, 2000, 20_000)
    got = {r["request_id"]: r for r in done.outcomes.collect()}
    assert [got[f"r{i}"]["status_code"] for i in range(8)] == [200, 200, 200, 200, 409, 400, 200, 200]
    assert got["r1"]["file_id"] == got["r0"]["file_id"] and got["r1"]["is_dedup"] and not got["r1"]["inserted"]
    assert got["r3"]["file_id"] == got["r2"]["file_id"] != got["r0"]["file_id"]
    assert sorted(got[f"r{i}"]["legacy_id"] for i in (0, 6, 7)) == [8, 9, 10]
    assert {r["file_id"]: r["tags"] for r in done.tags.collect()} == {got["r0"]["file_id"]: '["a","b"]', got["r2"]["file_id"]: '["t","u"]'}
    blobs = {r["hash"]: r for r in done.blobs.collect()}
    assert len(blobs) == 3 and {r["compression_alg"] for r in blobs.values()} == {"zstd", "none"}

    held = done.blobs.select("blob_id", "hash", "state", F.lit(None).cast("string").alias("write_owner"), F.lit(None).cast("timestamp_ntz").alias("write_started_at"), "volume_id", "blob_offset", "size_raw", "size_compressed", "compression_alg", F.lit(1).cast("bigint").alias("file_type_id"))
    sizes = done.volumes.withColumn("size_deleted", F.lit(0).cast("bigint"))
    after = Engine(done.files, held, sizes, engine.types, str(tmp_path))
    names = {r["name"]: bytes(r["content"]) for r in after.download(done.files).collect()}
    assert names == {"a.txt": big, "b.txt": big, "d.txt": small, "e.txt": b"y" * 300}
    assert after.integrity(True).first().asDict() == {"checked": 3, "unreadable": 0, "pending": 0, "missing_volumes": 0, "orphan_blobs": 0, "missing_blobs": 0, "status": "ok"}

    more = after.upload(requests(spark, [("z.txt", b"z" * 50, None, "", ""), ("a.txt", big, None, "", "")]), NOW, 2000, 20_000)
    told = {r["request_id"]: r for r in more.outcomes.collect()}
    assert told["r1"]["file_id"] == got["r0"]["file_id"] and told["r1"]["is_dedup"] and told["r0"]["legacy_id"] == 11
    records = volumes.read_records(spark, "volume", str(tmp_path))
    assert records.count() == 4 and records.where("not crc_ok").count() == 0

    left = after.delete(done.files.where("name = 'e.txt'"))
    assert left.blobs.count() == 2 and left.volumes.agg(F.sum("size_deleted")).first()[0] == 300 + schema.OVERHEAD - (300 - blobs_size(done, 300))
    moved = left.compact(0)
    assert moved.count() == 2


def blobs_size(done, raw):
    return done.blobs.where(F.col("size_raw") == raw).first()["size_compressed"]


def test_damaged_records(spark, tmp_path):
    rows = [(1, b, "none", bytearray(b"payload %d" % b)) for b in range(5)]
    volumes.write_volumes(spark.createDataFrame(rows, "volume_id bigint, blob_id bigint, algorithm string, payload binary"), str(tmp_path)).collect()
    path = tmp_path / "volume_00000001.dat"
    raw = bytearray(path.read_bytes())
    step = len(raw) // 5
    raw[step + 22] ^= 1  # a byte of the second payload
    raw[2 * step] ^= 1  # the third record's magic
    path.write_bytes(raw)
    places = spark.createDataFrame([(1, b, b * step, 9) for b in range(5)] + [(2, 9, 0, 9), (1, 10, 0, 9)], "volume_id bigint, blob_id bigint, blob_offset bigint, size_compressed bigint")
    got = {r["blob_id"]: r for r in volumes.read_blobs(places, str(tmp_path), True).collect()}
    assert {b: r["readable"] for b, r in got.items()} == {0: True, 1: False, 2: False, 3: True, 4: True, 9: False, 10: False}
    assert got[1]["crc_ok"] is False and got[2]["magic_ok"] is False and got[9]["in_folder"] is False and got[10]["id_ok"] is False and got[2]["crc_ok"] is None
    assert bytes(got[4]["payload"]) == b"payload 4" and got[1]["payload"] is None
    with pytest.raises(Exception, match="no record of blob 1"):
        volumes.compact_volumes(places.where("blob_id < 5"), str(tmp_path)).collect()
    assert path.read_bytes() == bytes(raw)


def test_lost_attempts(spark, tmp_path):
    """What an attempt wrote beyond the accounts is overwritten; drafts don't count as volumes."""
    first = spark.createDataFrame([(1, 1, "none", bytearray(b"one"))], "volume_id bigint, blob_id bigint, algorithm string, payload binary")
    second = spark.createDataFrame([(1, 2, "none", bytearray(b"two"))], first.schema)
    size = volumes.write_volumes(first, str(tmp_path)).first()["bytes"]
    held = spark.createDataFrame([(1, size)], "volume_id bigint, size_total bigint")
    for _ in range(2):
        volumes.write_volumes(second, str(tmp_path), held).collect()
    (tmp_path / "volume_00000009.dat.abc.part").write_bytes(b"torn")
    assert [(r["volume_id"], r["blob_id"]) for r in volumes.read_records(spark, "volume", str(tmp_path)).orderBy("offset").collect()] == [(1, 1), (1, 2)]
    assert volumes.read_records(spark, "index", str(tmp_path)).count() == 2
    assert volumes.read_records(spark, "files", str(tmp_path)).count() == 1
    assert volumes.read_records(spark, "files", str(tmp_path / "none")).count() == 0


def test_packed_source(spark, tmp_path):
    (tmp_path / "12000").mkdir()
    (tmp_path / "12000" / "0000012345.bz2").write_bytes(bz2.compress(b"old content"))
    rows = spark.createDataFrame([(12345, 1, "x/y/n.txt", ""), (12346, 2, "m.txt", "")], "raw_id bigint, legacy_id bigint, name string, tags string")
    got = {r["legacy_id"]: r for r in migration.requests(rows, str(tmp_path)).collect()}
    assert bytes(got[1]["content"]) == b"old content" and got[1]["name"] == "n.txt" and got[2]["content"] is None
    stored = spark.createDataFrame([(1, bytearray(b"new"))], "legacy_id bigint, content binary")
    found = migration.mismatches(migration.requests(rows, str(tmp_path)), stored)
    assert {r["legacy_id"]: r["status"] for r in found.collect()} == {1: "hash_mismatch", 2: "source_missing"}
    assert migration.write_report(found, str(tmp_path / "report")).first()["total_mismatches"] == 2
    assert [r["raw_id"] for r in migration.chosen(rows, True, 1).collect()] == [12346] and migration.chosen(rows).count() == 2


def test_jdbc_ranges(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    jdbc.write_table(spark.range(1, 1001).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string"))), url, "things")
    df = jdbc.read_table(spark, url, "things", "id", 5)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 1000 and df.agg(F.sum("id")).first()[0] == 500_500
    jdbc.write_table(spark.range(3).withColumn("name", F.lit("x")), url, "things", True)
    assert jdbc.read_table(spark, url, "things", "id", 5).count() == 3
    assert jdbc.next_ids({"things": jdbc.read_table(spark, url, "things")}, {"things": "id"}).first()["next_id"] == 3


ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import __spark_entry__
from cairnlake.sources import jdbc

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
source, target = "jdbc:derby:memory:source;create=true", "jdbc:derby:memory:target;create=true"
rows = spark.range(45_001).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("é"), "id")).alias("name"))
jdbc.write_table(rows, source, "things")
jdbc.write_table(rows.limit(0), source, "nothing")
for name in ("things", "nothing"):
    jdbc.write_table(rows.limit(3), target, name)
found = jdbc.copy_tables(spark, source, target, {"things": "id", "nothing": "id"}).collect()
assert sorted(map(tuple, found)) == [("nothing", 0, 0, 1, True), ("things", 45_001, 45_001, 45_001, True)], found
copied = jdbc.read_table(spark, target, "things", "id")
assert copied.exceptAll(rows).isEmpty() and rows.exceptAll(copied).isEmpty()
found = __spark_entry__.queries()["catalog_copy"](spark, "/root/testdata/sf0.001").collect()
assert {r["name"] for r in found} == {"blobs", "volumes"} and all(r["same"] and r["source_rows"] == r["target_rows"] > 0 for r in found), found
"""


def test_catalog_copy_on_a_cluster(tmp_path):
    home = tmp_path / "home"  # executors keep their logs in it
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path), "PYTHONPATH": str(Path(__file__).parents[1])}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    done = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, [x for x in done.stderr.splitlines() if "Error" in x or "Exception" in x][:20]


def test_single_pass_hash(spark):
    import hashlib

    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "c binary").select(formats.processed(F.col("c"), "gzip").alias("p"))
    one, none = (r["p"] for r in df.collect())
    assert one["hash"] == hashlib.blake2b(b"abc", digest_size=32).hexdigest() and formats.unpacked(bytes(one["packed"]), "gzip") == b"abc" and one["size_raw"] == 3
    assert none is None or none["hash"] is None


def test_jobs_on_a_timer(spark):
    ran = []
    job = schedule.every(spark, 0.2, lambda number: ran.append(number))
    until = time.time() + 60
    while len(ran) < 2 and time.time() < until:
        time.sleep(0.1)
    job.stop()
    assert len(ran) >= 2


def test_settings():
    from cairnlake.settings import Settings

    assert Settings.of({}) == Settings()
    got = Settings.of({"spark.cairnlake.volume_size": "5 gb", "spark.cairnlake.pending_age": "1h30m", "spark.cairnlake.compression": "zstd", "other": "1"})
    assert (got.volume_size, got.pending_age, got.compression, got.upload_size) == (5 << 30, 5400, "zstd", 500 << 20)
    for bad in ({"spark.cairnlake.volume_size": "x"}, {"spark.cairnlake.pending_age": "1d"}):
        with pytest.raises(ValueError):
            Settings.of(bad)
