"""Binary formats, placement, numbering, fragmentation."""

import io
import random

from duck import connect, same
from pyspark.sql import functions as F

from cairnlake.operators import catalog, ordered
from cairnlake.plans.registry import ORACLES, QUERIES
from cairnlake.sources import formats, volumes


def test_records_round_trip():
    blobs = [(7, 2, b"abc"), (8, 0, b""), (2**40, 1, bytes(range(256)))]
    raw = b"".join(formats.blob_record(*b) for b in blobs)
    found = [*formats.blobs_in(io.BytesIO(raw + b"junk" * 10))]
    assert [(b, a, p) for b, _, _, a, p, _ in found] == blobs and all(r[-1] for r in found)
    assert [r[1] for r in found] == [0, 29, 55]
    broken = bytearray(raw)
    broken[23] ^= 1
    assert [r[-1] for r in formats.blobs_in(io.BytesIO(bytes(broken)))] == [False, True, True]
    log = [("f", 1, 2, None, None, "", "n"), ("g", 3, 4, 5, 6, '["t"]', "é")]
    assert [*formats.log_in(io.BytesIO(b"".join(formats.log_record(*r) for r in log) + b"\x00\x00"))] == log
    assert [*formats.index_in(io.BytesIO(formats.index_record(1, 2, 3, 2, 4) + b"x"))] == [(1, 2, 3, 2, 4)]


def test_codecs():
    for a in ("none", "gzip", "zstd"):
        assert formats.unpacked(formats.packed(b"x" * 1000, a), a) == b"x" * 1000


def test_unsigned(spark):
    row = spark.createDataFrame([(bytearray(formats.index_record(2**40 + 1, 2**33, 5, 1, 9)),)], "b binary").select(*[formats.unsigned(F.col("b"), i, n) for i, n in ((1, 8), (9, 8), (17, 8), (26, 4))]).first()
    assert row[:] == (2**40 + 1, 2**33, 5, 9)


def test_volumes_and_spans(spark, tmp_path):
    rows = [(v, b, "zstd", bytearray(formats.packed(str(b).encode(), "zstd"))) for v in (1, 2, 12) for b in range(v * 10, v * 10 + 3)]
    done = volumes.write_volumes(spark.createDataFrame(rows, "volume_id bigint, blob_id bigint, algorithm string, payload binary"), str(tmp_path)).collect()
    assert sorted((r["volume_id"], r["records"]) for r in done) == [(1, 3), (2, 3), (12, 3)]
    got = volumes.read_records(spark, "volume", str(tmp_path)).collect()
    assert sorted((r["volume_id"], r["blob_id"], formats.unpacked(bytes(r["payload"]), r["algorithm"])) for r in got) == sorted((v, b, str(b).encode()) for v, b, *_ in rows)


def test_first_fit(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 700) for _ in range(400)] + [2000]
    used, want = [], []
    for s in sizes:
        need = s + 26
        at = -1 if need > 1000 else next((i for i, u in enumerate(used) if u + need <= 1000), len(used))
        if at == len(used):
            used.append(0)
        if at >= 0:
            used[at] += need
        want.append(at + 1 if at >= 0 else -1)
    df = spark.createDataFrame([*enumerate(sizes)], "seq bigint, size bigint").repartition(5)
    assert [r["volume_id"] for r in sorted(ordered.first_fit(df, 1000).collect())] == want


def test_first_fit_above_the_cap(spark, tmp_path):
    sizes, want = [65_511, 10, 70_000, 65_000, 510, 65_536, 65_510, 5], [1, 2, 3, 2, 4, 5, 6, 2]
    spark.createDataFrame([(i, "x" * s) for i, s in enumerate(sizes)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["first_fit_placement"](spark, str(tmp_path))
    assert [r["volume_id"] for r in sorted(found.collect())] == want
    same(found, connect(str(tmp_path)), ORACLES["first_fit_placement"])


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r["n"] == r["k"] + 1 for r in ordered.numbered(df, "k", "n").collect())


def test_fragmented(spark):
    v = spark.createDataFrame([(1, 100, 20), (2, 100, 21), (3, 0, 0)], "volume_id bigint, size_total bigint, size_deleted bigint")
    assert [r["volume_id"] for r in catalog.fragmented(v, 20).collect()] == [2]
    assert sorted(r["volume_id"] for r in catalog.fragmented(v, 0).collect()) == [1, 2]
