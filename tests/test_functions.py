"""Scalar functions on cases with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import media, text


def one(spark, expr, *values):
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("case", "result"), [("10MB", 10485760), ("1 g", 1073741824), ("512K", 524288), ("7", 7), ("1.5MB", None), ("1TB", None), ("10B", None), ("", None)])
def test_parse_bytes(spark, case, result):
    assert one(spark, text.parse_bytes, case) == result


@pytest.mark.parametrize(("case", "days"), [("1 day", 1), ("365 days", 365), ("12 months", 360), ("0 day", None), ("366 days", None), ("13 months", None), ("2 weeks", None), ("1 hour", None), ("day", None)])
def test_validity(spark, case, days):
    assert one(spark, text.validity_days, case) == days


@pytest.mark.parametrize(("case", "tags"), [("", None), ('["a","b"]', ["a", "b"]), ("x, y ,,z", ["x", "y", "z"]), ("[bad", ["[bad"])])
def test_decode_tags(spark, case, tags):
    assert one(spark, text.decode_tags, case) == tags


@pytest.mark.parametrize(("a", "b", "merged"), [("", "B", "B"), ("A", "", "A"), ('["b","a"]', "a, c", '["a","b","c"]')])
def test_merge_tags(spark, a, b, merged):
    assert one(spark, text.merge_tags, a, b) == merged


def test_paths(spark):
    uuid = "0e0f1a2b-0000-4000-8000-1234567890AB"
    assert one(spark, text.normal_path, f"/v2/files/{uuid}") == "/v2/files/:uuid"
    assert one(spark, text.normal_path, "/base/files/old/12") == "/base/files/old/:id"
    assert one(spark, text.normal_path, "/") == "/"
    assert one(spark, text.legacy_path, 12345) == "12000/0000012345.bz2"
    assert one(spark, text.path_escape, "a b+c/é*~") == "a%20b+c%2F%C3%A9%2A~"
    assert one(spark, text.basename, "a/b/c.txt") == "c.txt"


def test_format_bytes(spark):
    assert [one(spark, text.format_bytes, n) for n in (0, 1023, 1024, 1536, 5 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 GB"]
    assert [one(spark, text.format_bytes_short, n) for n in (0, 1536, 1 << 20)] == ["0 B", "1.5 KB", "1 MB"]


def test_format_bytes_rounds_ties_to_even(spark):
    import random

    r = random.Random(7)
    ties = [(20 * i + 5) * (1 << 10 * k) // 100 + d for k in range(1, 7) for i in range(5, 70) for d in (-1, 0, 1)]
    ns = [1280, 1152, 1792, 1023 * 1024 + 1000, (1 << 20) - 1, (1 << 63) - 1, *range(1024, 40_000, 32), *ties, *(r.randrange(1 << 63) >> r.randrange(52) for _ in range(3000))]

    def told(n, places, units):
        k = max((k for k in range(1, len(units) + 1) if n >= 1 << 10 * k), default=0)
        return (f"{n / (1 << 10 * k):.{places}f}" if k else str(n)), f" {units[k - 1]}" if k else " B"

    def short(number, unit):
        return (number.rstrip("0").rstrip(".") if "." in number else number) + unit

    ns = [n for n in ns if 0 < n < 1 << 63]
    n = F.col("n")
    found = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", text.format_bytes(n), text.format_bytes_short(n)).collect()
    assert [tuple(x) for x in found] == [(n, "".join(told(n, 1, ("KB", "MB", "GB", "TB", "PB", "EB"))), short(*told(n, 2, ("KB", "MB", "GB", "TB")))) for n in ns]


def test_masks(spark):
    assert one(spark, text.dsn_masked, "postgres://u:p@h/db") == "postgres://****:****@h/db"
    assert one(spark, text.secret_masked, "api_key", "x") == "********"
    assert one(spark, text.secret_masked, "key_path", "x") == "x"


def test_timestamps(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, text.timestamp_of, "2024-01-02 03:04:05") == at
    assert one(spark, text.timestamp_of, "2024-01-02T05:04:05+02:00") == at
    assert one(spark, text.timestamp_of, "1704164645") == at
    assert one(spark, text.timestamp_of, "soon") is None


@pytest.mark.parametrize(("src", "box", "result"), [((1920, 1080), (800, 800), (800, 450)), ((1080, 1920), (800, 800), (450, 800)), ((200, 200), (800, 800), (200, 200)), ((1000, 1000), (400, 400), (400, 400))])
def test_fitted(spark, src, box, result):
    assert one(spark, lambda *c: F.struct(*media.fitted(*c)), *src, *box)[:] == result


def test_compression(spark):
    assert one(spark, media.compression, "auto", 100, 90) == "zstd"
    assert one(spark, media.compression, "auto", 100, 91) == "none"
    assert one(spark, media.compression, "auto", 0, 5) == "none"
    assert one(spark, media.compression, "force", 100, 1) == "none"


def test_file_type(spark):
    kinds = {b"%PDF-1": "pdf", b"BMx": "BMP", b"RIFF0000WEBP": "WebP", b"RIFF0000WEB": "binary||", b"gaia_fake_file": "Fake", b"gaia_fake_file" + b" " * 120: "binary||", b"an Ident": "Ident", b"ident" + b" " * 11_995: "binary||", b"": "binary||"}
    for content, part in kinds.items():
        assert part in one(spark, media.file_type, bytearray(content))
