"""Queries of the state changes: writes, leases, upserts, deletion, expiry, purge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators import catalog as c
from cairnlake.operators import lifecycle as life
from cairnlake.plans.fixtures import CUTOFF, NOW, Lake
from cairnlake.plans.registry import query
from cairnlake.schema import OVERHEAD

GONE = "CAST(substr(file_id, 3) AS BIGINT) % 6 = 1"
DELETE_SQL = f""", lost AS (SELECT DISTINCT file_id FROM files WHERE {GONE}),
still AS (SELECT * FROM files WHERE file_id NOT IN (SELECT file_id FROM lost)),
dead AS (SELECT DISTINCT blob_id FROM files WHERE file_id IN (SELECT file_id FROM lost) EXCEPT SELECT blob_id FROM still)"""
EXPIRE_SQL = DELETE_SQL.replace(f"WHERE {GONE}", f"WHERE expires_at < TIMESTAMP '{NOW}'")
VOLUMES_SQL = f"""SELECT v.volume_id, size_total, CAST(size_deleted + coalesce((SELECT sum(size_compressed + {OVERHEAD}) FROM blobs b JOIN dead USING (blob_id) WHERE b.volume_id = v.volume_id), 0) AS BIGINT) AS size_deleted FROM volumes v"""


def gone(lake: Lake) -> DataFrame:
    return lake.files.where("cast(substring(file_id, 3) as bigint) % 6 = 1")


def removal(lake: Lake, ids: DataFrame):
    return life.deleted(lake.files, lake.blobs, lake.volumes, ids)


@query(DELETE_SQL + " SELECT file_id, blob_id FROM still")
def delete_gc_files(lake: Lake) -> DataFrame:
    return removal(lake, gone(lake))[0].select("file_id", "blob_id")


@query(DELETE_SQL + " SELECT blob_id FROM blobs WHERE blob_id NOT IN (SELECT blob_id FROM dead)")
def delete_gc_blobs(lake: Lake) -> DataFrame:
    return removal(lake, gone(lake))[1].select("blob_id")


@query(DELETE_SQL + VOLUMES_SQL)
def delete_gc_volumes(lake: Lake) -> DataFrame:
    return removal(lake, gone(lake))[2]


@query(EXPIRE_SQL + VOLUMES_SQL)
def expire_gc_volumes(lake: Lake) -> DataFrame:
    return removal(lake, c.expired(lake.files, NOW))[2]


@query(EXPIRE_SQL + " SELECT count(*) AS expired, (SELECT count(*) FROM dead JOIN blobs USING (blob_id)) AS blobs_freed FROM lost")
def expire_gc(lake: Lake) -> DataFrame:
    old = c.expired(lake.files, NOW)
    freed = lake.blobs.join(removal(lake, old)[1].select("blob_id"), "blob_id", "left_anti")
    return old.agg(F.count("*").alias("expired")).join(freed.agg(F.count("*").alias("blobs_freed")))


STALE_SQL = f", stale AS (SELECT blob_id FROM blobs b WHERE state = 'pending' AND (write_started_at IS NULL OR write_started_at < TIMESTAMP '{CUTOFF}') AND NOT EXISTS (SELECT 1 FROM files f WHERE f.blob_id = b.blob_id))"


@query(STALE_SQL + " SELECT blob_id, state FROM blobs WHERE blob_id NOT IN (SELECT blob_id FROM stale)")
def purge_pending(lake: Lake) -> DataFrame:
    return life.purged(lake.blobs, c.stale_pending(lake.blobs, lake.files, CUTOFF))[0].select("blob_id", "state")


@query("SELECT greatest(1, coalesce(max(legacy_id), 0) + 1) AS next_id FROM files")
def counter_state(lake: Lake) -> DataFrame:
    return lake.files.agg(F.greatest(F.lit(1), F.coalesce(F.max("legacy_id"), F.lit(0)) + 1).alias("next_id"))


@query("SELECT file_id, blob_id FROM files UNION ALL SELECT 'new-1', 5")
def insert_file(lake: Lake) -> DataFrame:
    return lake.files.select("file_id", "blob_id").unionAll(lake.spark.createDataFrame([("new-1", 5)], "file_id string, blob_id bigint"))


@query("SELECT blob_id, hash, state FROM blobs UNION ALL SELECT (SELECT max(blob_id) + 1 FROM blobs), 'fresh', 'pending'")
def insert_pending(lake: Lake) -> DataFrame:
    fresh = lake.blobs.agg((F.max("blob_id") + 1).alias("blob_id")).select("blob_id", F.lit("fresh").alias("hash"), F.lit("pending").alias("state"))
    return lake.blobs.select("blob_id", "hash", "state").unionAll(fresh)


FREE = f"coalesce(state = 'pending' AND (write_owner IS NULL OR write_owner IN ('', 'worker-1') OR write_started_at IS NULL OR write_started_at < TIMESTAMP '{CUTOFF}' - INTERVAL 5 MINUTE), false)"


@query(f"SELECT blob_id, CASE WHEN {FREE} THEN 'worker-1' ELSE write_owner END AS write_owner, CASE WHEN {FREE} THEN TIMESTAMP '{CUTOFF}' ELSE write_started_at END AS write_started_at FROM blobs")
def claim_lease(lake: Lake) -> DataFrame:
    free = F.coalesce(c.claimable("worker-1", CUTOFF), F.lit(False))
    return lake.blobs.select("blob_id", F.when(free, "worker-1").otherwise(F.col("write_owner")).alias("write_owner"), F.when(free, F.lit(CUTOFF).cast("timestamp_ntz")).otherwise(F.col("write_started_at")).alias("write_started_at"))


@query("SELECT blob_id, CASE WHEN state = 'pending' AND write_owner = 'worker-1' THEN NULL ELSE write_owner END AS write_owner FROM blobs")
def release_lease(lake: Lake) -> DataFrame:
    own = F.coalesce((F.col("state") == "pending") & (F.col("write_owner") == "worker-1"), F.lit(False))
    return lake.blobs.select("blob_id", F.when(~own, F.col("write_owner")).alias("write_owner"))


@query("""SELECT blob_id, CASE WHEN hit THEN 'committed' ELSE state END AS state, CASE WHEN hit THEN 9 ELSE volume_id END AS volume_id, CASE WHEN hit THEN blob_id * 100 ELSE blob_offset END AS blob_offset,
CASE WHEN NOT hit THEN write_owner END AS write_owner FROM (SELECT *, state = 'pending' AND blob_id % 2 = 0 AS hit FROM blobs)""")
def commit_location(lake: Lake) -> DataFrame:
    written = lake.blobs.where("state = 'pending' and blob_id % 2 = 0").select("blob_id", F.lit(9).cast("long").alias("volume_id"), (F.col("blob_id") * 100).alias("blob_offset"), "size_compressed")
    return life.committed(lake.blobs, written).select("blob_id", "state", "volume_id", "blob_offset", "write_owner")


@query("SELECT blob_id, CASE WHEN file_type_id = 2 AND blob_id % 5 = 0 THEN 3 ELSE file_type_id END AS file_type_id FROM blobs")
def upgrade_type(lake: Lake) -> DataFrame:
    """A blob of the generic type takes the type that a later look found."""
    found = lake.blobs.where("blob_id % 5 = 0").select("blob_id", F.lit(3).cast("long").alias("_type"))
    better = (F.col("file_type_id") == 2) & F.col("_type").isNotNull()
    return lake.blobs.join(found, "blob_id", "left").select("blob_id", F.when(better, F.col("_type")).otherwise(F.col("file_type_id")).alias("file_type_id"))


@query(""", lacking AS (SELECT DISTINCT 'text/' || lang AS mime_type, 'text' AS category, lang AS subtype FROM documents)
SELECT * FROM file_types UNION ALL SELECT 3 + row_number() OVER (ORDER BY mime_type), mime_type, category, subtype FROM lacking""")
def file_type_upsert(lake: Lake) -> DataFrame:
    wanted = lake.documents.select(F.concat(F.lit("text/"), "lang").alias("mime_type"), F.lit("text").alias("category"), F.col("lang").alias("subtype"))
    return life.dimension(lake.file_types, wanted, "file_type_id", ["mime_type", "category", "subtype"])


@query("SELECT volume_id, CAST(sum(size_total) AS BIGINT) AS size_total FROM (SELECT volume_id, size_total FROM volumes UNION ALL SELECT 1 + blob_id % 10, size_raw FROM blobs) GROUP BY 1")
def volume_add(lake: Lake) -> DataFrame:
    changes = lake.blobs.select((1 + F.col("blob_id") % 10).alias("volume_id"), F.col("size_raw").alias("size_total"))
    return life.added(lake.volumes, changes, "volume_id", "size_total")


@query("SELECT volume_id, greatest(size_total - 250000, 0) AS size_total FROM volumes")
def volume_subtract(lake: Lake) -> DataFrame:
    return lake.volumes.select("volume_id", F.greatest(F.col("size_total") - 250_000, F.lit(0)).alias("size_total"))


@query("SELECT file_id, CASE WHEN legacy_id % 10 = 1 THEN '[\"kept\"]' ELSE tags END AS tags FROM files")
def replace_tags(lake: Lake) -> DataFrame:
    new = lake.files.where("legacy_id % 10 = 1").select("file_id", F.lit('["kept"]').alias("_tags"))
    return lake.files.join(new, "file_id", "left").select("file_id", F.coalesce("_tags", "tags").alias("tags"))


REQUESTS_SQL = """, req AS (SELECT 'r-' || substr(file_id, 3) AS request_id, blob_id, name, CASE WHEN legacy_id % 2 = 0 THEN expires_at ELSE NULL END AS expires_at, legacy_id FROM files)"""


def requested(lake: Lake) -> DataFrame:
    return lake.files.select(F.concat(F.lit("r-"), F.substring("file_id", 3, 20)).alias("request_id"), "blob_id", "name", F.when(F.col("legacy_id") % 2 == 0, F.col("expires_at")).alias("expires_at"), "legacy_id")


@query(REQUESTS_SQL + """ SELECT r.request_id, coalesce(min(f.file_id), r.request_id) AS file_id, min(f.file_id) IS NULL AS inserted
FROM req r LEFT JOIN files f ON r.blob_id = f.blob_id AND r.name = f.name AND r.expires_at IS NOT DISTINCT FROM f.expires_at GROUP BY r.request_id""")
def save_file(lake: Lake) -> DataFrame:
    return life.saved_files(lake.files, requested(lake))


@query(REQUESTS_SQL + """ SELECT r.request_id, CASE WHEN EXISTS (SELECT 1 FROM files f WHERE f.legacy_id = r.legacy_id AND f.blob_id <> r.blob_id + r.blob_id % 2) THEN 'conflict' ELSE 'ok' END AS outcome FROM req r""")
def legacy_conflict(lake: Lake) -> DataFrame:
    moved = requested(lake).withColumn("blob_id", F.col("blob_id") + F.col("blob_id") % 2)
    return life.legacy_conflicts(lake.files, moved)


@query(REQUESTS_SQL + """ SELECT count(*) AS uploads, count(DISTINCT hash) AS stored, CAST(sum(size) AS BIGINT) AS bytes FROM uploads""")
def ingest_summary(lake: Lake) -> DataFrame:
    """A batch of uploads: how many, how many contents they store, their bytes; contents are counted after being grouped."""
    by = lake.uploads.groupBy("hash").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    return by.agg(F.sum("n").alias("uploads"), F.count("*").alias("stored"), F.sum("b").alias("bytes"))
