"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import functools

import pytest
from brute import prose
from pyspark.sql import functions as F

import corpus_pipeline
from cairnlake.llm import decontaminate, jaccard_join, phrase_dedup, quality_rules, quote_linking, sentencepieces, sharding, suffix_dedup, toxicity, url_filter

FOLDER = "/root/testdata/sf0.001"
#: Names that operators add or use inside, in other cases and with underscores.
CLASHES = ("_id", "_text", "_rest", "_shard", "_key", "_c", "_slot", "_hit", "_raw", "N_Words", "KEPT", "Slot", "SHARD", "Score", "Host", "Rule", "Items", "n_Hit", "Piece_IDs", "Decoded", "BODY", "Root", "Depth", "Thread", "Node", "id", "hash", "Bucket", "`a.b c`")


def rows():
    import random

    rng = random.Random(9)
    text = prose(rng, 80)
    long = " ".join(prose(rng, 50) for _ in range(60)) * 60  # megabytes, and repeats of itself
    return [(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, "x" * 300_000), (7, long), (None, "word"), (8, "one two"), (9, "> quoted\nown")]


def frame(spark, held, key="doc_id", text="text"):
    df = spark.createDataFrame(held, f"{key} bigint, {text} string").repartition(3)
    return df.select("*", *[F.lit(f"own {k}").alias(c.strip("`")) for k, c in enumerate(CLASHES)])


@functools.cache
def machine():
    return toxicity.train(["a bad blurgo here."] * 20 + ["a fine day."] * 20, [1] * 20 + [0] * 20)


def piece(spark, df):
    import public_tokenizers

    return sentencepieces.encode_decode(df, public_tokenizers.path(sentencepieces.MODEL))


def items(spark):
    return spark.createDataFrame([(1, "one two"), (1, "word"), (None, "quoted")], "item_id bigint, text string")


OPERATORS = {
    "toxicity": lambda s, df: toxicity.score(df, machine()),
    "sentencepiece": piece,
    "quality": lambda s, df: quality_rules.judge(quality_rules.statistics(df), quality_rules.DecisionList([[("f_words", "<=", 3.0)]])),
    "quotes": lambda s, df: quote_linking.linked(df.withColumn("turn", F.lit(1)), "doc_id", "turn", "text"),
    "urls": lambda s, df: url_filter.judge(df, ([0.0] * url_filter.BUCKETS, 0.0), url="text"),
    "decontamination": lambda s, df: decontaminate.found(df, items(s)),
    "decontamination cleaned": lambda s, df: decontaminate.found(df, items(s), cleaned=True),
    "phrases": lambda s, df: phrase_dedup.removed(df),
    "suffixes": lambda s, df: suffix_dedup.removed(df),
    "sharding": lambda s, df: sharding.placed(df, "doc_id", ["a", "b", "c"], 503),
}
NEW = {"score", "piece_ids", "decoded", "n_words", "body", "root", "depth", "thread", "host", "rule", "n_hit", "items", "kept", "slot", "shard"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, tmp_path, name):
    df = frame(spark, rows())
    out = OPERATORS[name](spark, df)
    out.write.parquet(str(tmp_path / "out"))  # refuses columns of one name in two cases
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(rows())
    lower = [c.lower() for c in out.columns]
    assert len(set(lower)) == len(lower)
    for k, c in enumerate(CLASHES):
        name = c.strip("`")
        if name.lower() not in NEW:
            assert got.where(F.col(f"`{name}`") == f"own {k}").count() == len(rows())
    if "cleaned" not in str(out.columns) and "text" in out.columns and not name.endswith("cleaned"):
        assert sorted(map(repr, (r[0] for r in got.select("doc_id").collect()))) == sorted(repr(d) for d, _ in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](spark, frame(spark, rows()).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("operator", [jaccard_join.joined, jaccard_join.survivors])
def test_joins(spark, tmp_path, operator):
    operator(frame(spark, rows())).write.parquet(str(tmp_path / "out"))
    assert operator(frame(spark, rows()).where("doc_id < 0")).count() == 0
    got = spark.read.parquet(str(tmp_path / "out"))
    if operator is jaccard_join.survivors:
        assert got.columns == frame(spark, rows()).columns and got.where("text is null").count() == 2
    else:
        assert got.count() == len(rows())


@pytest.mark.parametrize("name", ["phrases", "suffixes"])
def test_ids_that_are_texts(spark, name):
    with pytest.raises(TypeError, match="whole numbers"):
        OPERATORS[name](spark, spark.createDataFrame([("x", "y")], "doc_id string, text string"))


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, number):
    stage = corpus_pipeline.STAGES[number][1]
    df = frame(spark, rows()).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    stage(spark, df, FOLDER).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns[:5] == list(corpus_pipeline.COLUMNS)
    if number in (2, 3, 4):
        assert got.count() == len(rows()) and got.where("text is null").count() == 2
    assert stage(spark, df.where("doc_id < 0"), FOLDER).count() == 0
