"""Queries of upkeep: counters, freed bytes, progress, tidied tables, older schemas, errors, contents inline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake import schema
from cairnlake.operators import catalog as c
from cairnlake.operators import lifecycle as life
from cairnlake.operators import metrics, migration, ordered, uploads
from cairnlake.plans import flows
from cairnlake.plans.fixtures import CUTOFF, NOW, Lake
from cairnlake.plans.lifecycle import STALE_SQL
from cairnlake.plans.registry import PATH_SQL, query
from cairnlake.schema import OVERHEAD
from cairnlake.session import shared_dir
from cairnlake.sources import formats, tables
from cairnlake.streaming import schedule


def counter(lake: Lake, value: int) -> DataFrame:
    return lake.spark.createDataFrame([(value,)], "next_id bigint")


@query(STALE_SQL.replace("FROM blobs b WHERE", "FROM half b WHERE").replace(", stale AS", ", half AS (SELECT * REPLACE (CASE WHEN state = 'pending' AND blob_id % 2 = 0 THEN 1 + blob_id % 3 ELSE volume_id END AS volume_id) FROM blobs), stale AS") + f"""
SELECT volume_id, CAST(sum(size_compressed + {OVERHEAD}) AS BIGINT) AS freed FROM half JOIN stale USING (blob_id) WHERE volume_id > 0 AND size_compressed > 0 GROUP BY 1""")
def purge_freed(lake: Lake) -> DataFrame:
    """Bytes that dropped pending blobs had taken, for those that had been written."""
    half = lake.blobs.withColumn("volume_id", F.when((F.col("state") == "pending") & (F.col("blob_id") % 2 == 0), 1 + F.col("blob_id") % 3).otherwise(F.col("volume_id")))
    return schedule.purge(lake.files, half, CUTOFF)[1]


@query("SELECT CAST(greatest(max(legacy_id) + 1, 50) AS BIGINT) AS next_id FROM files")
def counter_ensure(lake: Lake) -> DataFrame:
    """A counter kept ahead of the ids that are given."""
    return life.ensured(counter(lake, 50), lake.files.where("legacy_id is not null").select("legacy_id"))


@query("SELECT file_id, 9000000 + row_number() OVER (ORDER BY CAST(substr(file_id, 3) AS BIGINT)) - 1 AS legacy_id FROM files WHERE legacy_id IS NULL")
def counter_allocate(lake: Lake) -> DataFrame:
    wanting = lake.files.where("legacy_id is null").select("file_id", F.substring("file_id", 3, 20).cast("long").alias("seq"))
    return life.allocated(counter(lake, 9_000_000), wanting, "seq")[0].select("file_id", "legacy_id")


@query("SELECT CAST(9000000 + count(*) AS BIGINT) AS next_id FROM files WHERE legacy_id IS NULL")
def counter_after(lake: Lake) -> DataFrame:
    wanting = lake.files.where("legacy_id is null").select("file_id")
    return life.allocated(counter(lake, 9_000_000), wanting, "file_id")[1]


@query("SELECT n AS number, n / (SELECT count(*) FROM blobs) * 100 AS percent FROM (SELECT row_number() OVER (ORDER BY blob_id) AS n FROM blobs) WHERE n % 100 = 0")
def progress_marks(lake: Lake) -> DataFrame:
    return life.progress(lake.blobs, "blob_id")


@query("SELECT count(*) AS rows, CAST(sum(blob_id) AS BIGINT) AS ids, 1::BIGINT AS files_after, true AS fewer FROM blobs")
def table_tidied(lake: Lake) -> DataFrame:
    """A table of many small files, rewritten into few."""
    path = f"{shared_dir(lake.spark)}/tidied-{uuid.uuid4().hex}"
    lake.blobs.repartition(12).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    done = tables.tidied(lake.spark, path).select((F.col("files_after") < F.col("files_before")).alias("fewer"))
    held = lake.spark.read.parquet(path)
    files = held.select(F.input_file_name().alias("f")).distinct().agg(F.count("*").alias("files_after"))
    return held.agg(F.count("*").alias("rows"), F.sum("blob_id").alias("ids")).join(files).join(done)


@query("SELECT blob_id, hash, NULL::VARCHAR AS write_owner, CAST(volume_id AS BIGINT) AS volume_id FROM blobs")
def schema_migration(lake: Lake) -> DataFrame:
    """Blobs of an older schema: no lease columns, volumes as text, a column that is no longer known."""
    old = lake.blobs.select("blob_id", "hash", F.col("volume_id").cast("string").alias("VOLUME_ID"), F.lit(1).alias("dropped"))
    return schema.migrated(old, schema.BLOBS).select("blob_id", "hash", "write_owner", "volume_id")


@query("""SELECT file_id, CASE WHEN b.blob_id IS NULL THEN 'no blob' ELSE 'no file type' END AS error FROM files f LEFT JOIN blobs b ON f.blob_id = b.blob_id
WHERE b.blob_id IS NULL OR b.file_type_id = 3""")
def file_info_errors(lake: Lake) -> DataFrame:
    """Files that can't be shown, with the part that lacks; one type is taken out of the dimension."""
    return c.broken_files(lake.files, lake.blobs, lake.file_types.where("file_type_id <> 3"))


@query("""SELECT f.file_id, b.hash, t.mime_type, base64(encode(g.text)) AS content_base64 FROM files f JOIN blobs b ON f.blob_id = b.blob_id JOIN file_types t ON b.file_type_id = t.file_type_id
JOIN (SELECT sha256(text) AS hash, any_value(text) AS text FROM documents GROUP BY 1) g ON g.hash = b.hash WHERE f.legacy_id % 10 = 8""")
def file_info_inline(lake: Lake) -> DataFrame:
    """Info of files by legacy id, with their whole content in base64."""
    info = c.file_info(lake.files.where("legacy_id % 10 = 8"), lake.blobs, lake.file_types)
    texts = lake.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.first("text").cast("binary").alias("content"))
    return c.inlined(info, lake.blobs.select("blob_id", "hash").join(texts, "hash")).select("file_id", "hash", "mime_type", F.regexp_replace("content_base64", "\r\n", "").alias("content_base64"))


@query("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size_raw, true AS same FROM documents", fixtures=False)
def single_pass(lake: Lake) -> DataFrame:
    """Hash, raw size and packed bytes of each content, from one pass."""
    raw = F.col("text").cast("binary")
    once = lake.documents.select("doc_id", raw.alias("raw"), formats.processed(raw, "zstd", "sha256").alias("p"))
    return once.select("doc_id", "p.hash", "p.size_raw", (formats.unpack(F.col("p.packed"), F.lit("zstd")) == F.col("raw")).alias("same"))


@query("""SELECT 'files_total' AS name, count(*) AS value FROM files UNION ALL SELECT 'blobs_total', count(*) FROM blobs UNION ALL SELECT 'volumes_total', count(*) FROM volumes
UNION ALL SELECT 'storage_total_bytes', CAST(sum(size_total) AS BIGINT) FROM volumes UNION ALL SELECT 'storage_deleted_bytes', CAST(sum(size_deleted) AS BIGINT) FROM volumes""")
def volume_gauges(lake: Lake) -> DataFrame:
    return schedule.gauges(lake.files, lake.blobs, lake.volumes)


@query(flows.MIGRATE_SQL + "SELECT CAST(legacy_id AS BIGINT) AS legacy_id, CASE WHEN raw_id % 19 = 0 OR strlen(text) > 1000000 THEN 400 ELSE 200 END AS status_code, raw_id % 19 <> 0 AS inserted FROM src")
def migration_outcomes(lake: Lake) -> DataFrame:
    """Source files of an older store, taken in as uploads under their legacy ids."""
    rows, folder = flows.sources(lake)
    made = migration.requests(rows, folder)
    done = uploads.uploaded(made, lake.files, lake.blobs, lake.volumes, NOW, flows.MOST, 1_000_000, "none", lambda x: F.sha2(x, 256))
    return done.outcomes.select(F.substring("request_id", 3, 20).cast("long").alias("legacy_id"), "status_code", "inserted")


AT = "2024-01-10 00:00:00"


@query(f""", r AS (SELECT ts, method, {PATH_SQL} AS path, status, duration_s, CASE WHEN method = 'GET' AND status = 200 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS bytes_read FROM requests WHERE path <> '/metrics'),
u AS (SELECT CASE WHEN seq % 50 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN seq % 3 = 0 THEN 'text' ELSE 'binary' END AS file_type, (seq % 7) / 8 AS duration_s, size, seq <> min(seq) OVER (PARTITION BY hash) AS is_dedup FROM uploads)
SELECT 'http_requests_total' AS name, 'method=' || method || ',path=' || path || ',status=' || status AS labels, CAST(count(*) AS DOUBLE) AS value FROM r GROUP BY method, path, status
UNION ALL SELECT 'http_request_duration_seconds_sum', 'method=' || method || ',path=' || path, round(sum(duration_s), 6) FROM r GROUP BY method, path
UNION ALL SELECT 'http_requests_in_flight', '', CAST(count(*) FILTER (WHERE ts <= TIMESTAMP '{AT}' AND ts + to_microseconds(CAST(round(duration_s * 1000000) AS BIGINT)) > TIMESTAMP '{AT}') AS DOUBLE) FROM r
UNION ALL SELECT 'upload_ops_total', 'status=' || status || ',file_type=' || file_type, CAST(count(*) AS DOUBLE) FROM u GROUP BY status, file_type
UNION ALL SELECT 'upload_duration_seconds_sum', '', round(sum(duration_s), 6) FROM u
UNION ALL SELECT 'storage_dedup_hits_total', '', CAST(count(*) FILTER (WHERE is_dedup AND status = 'success') AS DOUBLE) FROM u
UNION ALL SELECT 'storage_deleted_bytes_total', '', CAST(sum(size_deleted) AS DOUBLE) FROM volumes
UNION ALL SELECT 'storage_bytes_total', '', CAST(sum(size_total) AS DOUBLE) FROM volumes
UNION ALL SELECT 'blob_bytes_written_total', '', CAST(sum(size) AS DOUBLE) FROM u
UNION ALL SELECT 'blob_bytes_read_total', '', CAST(sum(bytes_read) AS DOUBLE) FROM r""")
def metric_series(lake: Lake) -> DataFrame:
    """All series of requests, uploads and volumes."""
    reads = lake.requests.withColumn("bytes_read", F.when((F.col("method") == "GET") & (F.col("status") == 200), F.floor("value")).otherwise(0)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    s = F.col("seq")
    told = ordered.dedup_assignment(lake.uploads).join(lake.uploads.select("seq", "size"), "seq")
    done = told.select(F.when(s % 50 == 0, "error").otherwise("success").alias("status"), F.when(s % 3 == 0, "text").otherwise("binary").alias("file_type"), (s % 7 / 8).alias("duration_s"), F.col("size").alias("bytes_written"), "is_dedup")
    return metrics.series(reads, done, lake.volumes, AT)
