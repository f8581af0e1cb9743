"""The corpus pipeline: quality rules, near duplicates, repeated strings, benchmark passages, token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``; other columns
of ``docs``, whatever their names, go. Empty tables stay empty, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import decontaminate, jaccard_join, quality_rules, sentencepieces, suffix_dedup
from cairnlake.llm.common import read
from cairnlake.session import drop, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates share four of five five-word shingles.
NEAR = jaccard_join.Rule(size=5, percent=80)


def documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it now is."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no learned rule rejects; null and empty texts fail the base rule."""
    return documents(quality_rules.quality(docs, read(spark, sf_dir, "labels")).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the least id and text hash, null ids last; rows equal in both stay once."""
    return documents(jaccard_join.survivors(docs, rule=NEAR))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that earlier documents hold; characters cut in two go, a null text stays null."""
    cut = suffix_dedup.removed(docs)
    kept = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(suffix_dedup.characters(F.col("kept")))
    return documents(cut.withColumn("text", kept))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark; a null text stays null, null ids and repeated rows are searched as any."""
    return documents(decontaminate.found(docs, read(spark, sf_dir, "benchmark"), cleaned=True))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids (little-endian unsigned 32-bit), how many they are, and the digests of ids and decoded text.

    A null text is encoded as an empty one and stays null; repeated rows each keep theirs.
    """
    import public_tokenizers

    encoded = sentencepieces.encode_decode(docs, public_tokenizers.path(sentencepieces.MODEL))
    digests = (F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
    return encoded.select(*COLUMNS, (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"), "piece_ids", *digests)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", token_ids),
]
#: Learned rules and token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared folder and read again.

    A stage's table goes as soon as the next one is written; the last one that is needed goes when the driver's JVM ends.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs)
            if before:
                drop(spark, before)
            before = path
    return docs
