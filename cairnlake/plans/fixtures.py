"""Catalog tables derived from the driver's tables, as DataFrames and as DuckDB CTEs of the same names."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.schema import OVERHEAD

NOW, CUTOFF = "2024-01-12 00:00:00", "2024-01-01 06:00:00"
TYPES = [(1, "text/plain", "text", "plain"), (2, "application/octet-stream", "binary", ""), (3, "image/png", "image", "PNG")]


class Lake:
    """The catalog over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def hashed(self) -> DataFrame:
        """Documents with the hash of their text and the id of its blob."""
        docs = self.documents.withColumn("hash", F.sha2("text", 256))
        return docs.join(docs.groupBy("hash").agg((F.min("doc_id") + 1).alias("owner")), "hash")

    @cached_property
    def blob_all(self) -> DataFrame:
        base = self.documents.groupBy(F.sha2("text", 256).alias("hash")).agg((F.min("doc_id") + 1).alias("blob_id"), F.first(F.octet_length("text").cast("long")).alias("size_raw"))
        pending, b = F.col("blob_id") % 17 == 0, F.col("blob_id")
        out = base.select(
            "blob_id",
            "hash",
            F.when(pending, "pending").otherwise("committed").alias("state"),
            F.when(pending & (b % 4 == 1), F.concat(F.lit("worker-"), (b % 3).cast("string"))).alias("write_owner"),
            F.when(pending & (b % 2 == 0), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(blob_id as int))")).alias("write_started_at"),
            F.when(~pending, 1 + b % 8).alias("volume_id"),
            "size_raw",
            F.when(b % 3 == 0, F.col("size_raw")).otherwise(F.expr("(size_raw * 6) div 10")).alias("size_compressed"),
            F.when(b % 3 == 0, "none").otherwise("zstd").alias("compression_alg"),
            (1 + b % 3).alias("file_type_id"),
        )
        before = Window.partitionBy("volume_id").orderBy("blob_id").rowsBetween(Window.unboundedPreceding, -1)
        return out.withColumn("blob_offset", F.when(F.col("volume_id").isNotNull(), F.coalesce(F.sum(F.col("size_compressed") + OVERHEAD).over(before), F.lit(0))))

    @cached_property
    def blobs(self) -> DataFrame:
        return self.blob_all.where("blob_id % 11 <> 0")

    @cached_property
    def files(self) -> DataFrame:
        d = F.col("doc_id")
        quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(doc_id as int))")
        return self.hashed.where("doc_id % 13 <> 12 and owner % 11 <> 0").select(
            F.concat(F.lit("f-"), d.cast("string")).alias("file_id"),
            F.concat("lang", F.lit(".txt")).alias("name"),
            F.when(d % 23 == 22, -d - 1).otherwise(F.col("owner")).alias("blob_id"),
            F.when(d % 5 == 0, None).when(d % 50 == 7, d + 1).otherwise(d).alias("legacy_id"),
            created.alias("created_at"),
            F.when(d % 3 == 0, created + F.expr("make_dt_interval(cast(1 + doc_id % 30 as int))")).alias("expires_at"),
            F.when(d % 4 == 0, "")
            .when(d % 4 == 1, F.concat(F.lit("["), quote(F.col("lang")), F.lit(","), quote(F.col("source")), F.lit("]")))
            .when(d % 4 == 2, F.concat("lang", F.lit(", "), "source"))
            .otherwise(F.concat(F.lit("["), quote(F.col("source")), F.lit("]")))
            .alias("tags"),
        )

    @cached_property
    def volumes(self) -> DataFrame:
        framed = F.col("size_compressed") + OVERHEAD
        return self.blob_all.where("volume_id is not null").groupBy("volume_id").agg(F.sum(framed).alias("size_total"), F.sum(F.when(F.col("blob_id") % 11 == 0, framed).otherwise(0)).alias("size_deleted"))

    @cached_property
    def file_types(self) -> DataFrame:
        return self.spark.createDataFrame(TYPES, "file_type_id bigint, mime_type string, category string, subtype string")

    @cached_property
    def replay_log(self) -> DataFrame:
        """File records in log order; some are logged again later with other tags."""
        seq = F.substring("file_id", 3, 20).cast("long")
        first = self.files.withColumn("seq", seq)
        again = first.where("seq % 7 = 0").withColumn("seq", F.col("seq") + 1_000_000).withColumn("tags", F.lit('["again"]'))
        return first.unionByName(again)

    @cached_property
    def uploads(self) -> DataFrame:
        """Uploads in the order of arrival."""
        return self.hashed.select(F.col("doc_id").alias("seq"), "hash", F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("legacy_id"))

    @cached_property
    def incoming(self) -> DataFrame:
        """A batch of uploads: contents that are known, new, repeated and too long; ids that are free, taken, named twice or left out."""
        d = F.col("doc_id")
        content = F.when(d % 6 == 5, F.concat("lang", "source")).when(d % 6 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        validity = F.when(d % 8 == 0, "").when(d % 8 == 1, "bogus").when(d % 8 == 2, "7 days").otherwise("1 month")
        return self.documents.select(
            F.concat(F.lit("u-"), d.cast("string")).alias("request_id"),
            d.alias("seq"),
            F.concat("lang", F.lit(".txt")).alias("name"),
            content.cast("binary").alias("content"),
            F.lit("").alias("content_type"),
            F.when(d % 5 == 0, None).when(d % 5 == 1, d % 700).otherwise(5_000_000 + F.expr("doc_id div 2")).cast("long").alias("legacy_id"),
            validity.alias("validity"),
            F.when(d % 3 == 0, "").otherwise(F.concat("lang", F.lit(", "), "source")).alias("tags"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        user = F.col("user_id").cast("string")
        path = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/v2/files/"), F.lpad(user, 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(user, 12, "0"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("/base/files/old/"), user)).otherwise(F.concat(F.lit("/"), "event_type"))
        return self.table("events").select("event_id", "ts", F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"), path.alias("path"), F.when(F.col("value") > 100, 500).when(F.col("value") > 80, 404).otherwise(200).alias("status"), (F.col("value") / 1000).alias("duration_s"), "value")

    @cached_property
    def jobs(self) -> DataFrame:
        e = F.col("event_id")
        status = F.when(e % 4 == 0, "pending").when(e % 4 == 1, "running").when(e % 4 == 2, "completed").otherwise("failed")
        done = F.col("ts") + F.expr("make_dt_interval(0, 0, 0, cast(cast(event_id % 5000 as int) as decimal(18,6)))")
        return self.table("events").select(e.alias("job_id"), F.col("event_type").alias("type"), status.alias("status"), F.col("ts").alias("started_at"), F.when(e % 4 >= 2, done).alias("completed_at"))


FIXTURES = f"""
WITH RECURSIVE g AS (SELECT sha256(text) AS hash, min(doc_id) + 1 AS blob_id, CAST(any_value(strlen(text)) AS BIGINT) AS size_raw FROM documents GROUP BY 1),
blob_all0 AS (SELECT blob_id, hash, CASE WHEN blob_id % 17 = 0 THEN 'pending' ELSE 'committed' END AS state,
  CASE WHEN blob_id % 17 = 0 AND blob_id % 4 = 1 THEN 'worker-' || (blob_id % 3) END AS write_owner,
  CASE WHEN blob_id % 17 = 0 AND blob_id % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(blob_id) END AS write_started_at,
  CASE WHEN blob_id % 17 <> 0 THEN 1 + blob_id % 8 END AS volume_id, size_raw,
  CASE WHEN blob_id % 3 = 0 THEN size_raw ELSE (size_raw * 6) // 10 END AS size_compressed,
  CASE WHEN blob_id % 3 = 0 THEN 'none' ELSE 'zstd' END AS compression_alg, 1 + blob_id % 3 AS file_type_id FROM g),
blob_all AS (SELECT *, CASE WHEN volume_id IS NOT NULL THEN CAST(coalesce(sum(size_compressed + {OVERHEAD}) OVER (PARTITION BY volume_id ORDER BY blob_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS blob_offset FROM blob_all0),
blobs AS (SELECT * FROM blob_all WHERE blob_id % 11 <> 0),
hashed AS (SELECT d.*, g.hash, g.blob_id AS owner FROM documents d JOIN g ON sha256(d.text) = g.hash),
files AS (SELECT 'f-' || doc_id AS file_id, lang || '.txt' AS name, CASE WHEN doc_id % 23 = 22 THEN -doc_id - 1 ELSE owner END AS blob_id,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 50 = 7 THEN doc_id + 1 ELSE doc_id END AS legacy_id,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
  CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_days(CAST(1 + doc_id % 30 AS INT)) END AS expires_at,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '["' || lang || '","' || source || '"]' WHEN 2 THEN lang || ', ' || source ELSE '["' || source || '"]' END AS tags
  FROM hashed WHERE doc_id % 13 <> 12 AND owner % 11 <> 0),
volumes AS (SELECT volume_id, CAST(sum(size_compressed + {OVERHEAD}) AS BIGINT) AS size_total, CAST(sum(CASE WHEN blob_id % 11 = 0 THEN size_compressed + {OVERHEAD} ELSE 0 END) AS BIGINT) AS size_deleted FROM blob_all WHERE volume_id IS NOT NULL GROUP BY 1),
file_types AS (SELECT * FROM (VALUES (1::BIGINT, 'text/plain', 'text', 'plain'), (2, 'application/octet-stream', 'binary', ''), (3, 'image/png', 'image', 'PNG')) AS t(file_type_id, mime_type, category, subtype)),
replay0 AS (SELECT *, CAST(substr(file_id, 3) AS BIGINT) AS seq FROM files),
replay_log AS (SELECT * FROM replay0 UNION ALL SELECT file_id, name, blob_id, legacy_id, created_at, expires_at, '["again"]', seq + 1000000 FROM replay0 WHERE seq % 7 = 0),
uploads AS (SELECT doc_id AS seq, hash, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS legacy_id FROM hashed),
incoming AS (SELECT 'u-' || doc_id AS request_id, doc_id AS seq, lang || '.txt' AS name, CASE doc_id % 6 WHEN 5 THEN lang || source WHEN 3 THEN text || '!' ELSE text END AS content,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN doc_id % 700 ELSE 5000000 + doc_id // 2 END AS legacy_id,
  CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'bogus' WHEN 2 THEN '7 days' ELSE '1 month' END AS validity, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ', ' || source END AS tags FROM documents),
requests AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE event_id % 3 WHEN 0 THEN '/v2/files/' || lpad(CAST(user_id AS VARCHAR), 8, '0') || '-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') WHEN 1 THEN '/base/files/old/' || user_id ELSE '/' || event_type END AS path,
  CASE WHEN value > 100 THEN 500 WHEN value > 80 THEN 404 ELSE 200 END AS status, value / 1000 AS duration_s, value FROM events),
jobs AS (SELECT event_id AS job_id, event_type AS type, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, ts AS started_at,
  CASE WHEN event_id % 4 >= 2 THEN ts + to_seconds(event_id % 5000) END AS completed_at FROM events)
"""
