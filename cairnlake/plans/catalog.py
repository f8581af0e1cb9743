"""Queries over the catalog: lookups, predicates, integrity, statistics, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators import catalog as c
from cairnlake.operators import ordered
from cairnlake.plans.fixtures import CUTOFF, NOW, Lake
from cairnlake.plans.registry import PATH_SQL, query
from cairnlake.schema import OVERHEAD

CAP = 65_536
#: The upper bounds of the duration histogram.
BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 2.5, 5, 10, 30, 60]


@query("SELECT * FROM files WHERE file_id = 'f-7'")
def file_by_id(lake: Lake) -> DataFrame:
    return lake.files.where("file_id = 'f-7'")


@query("SELECT blob_id, hash, state FROM blobs WHERE hash = (SELECT min(hash) FROM blobs)")
def blob_by_hash(lake: Lake) -> DataFrame:
    wanted = lake.blobs.agg(F.min("hash").alias("hash"))
    return lake.blobs.join(wanted, "hash", "left_semi").select("blob_id", "hash", "state")


@query("SELECT blob_id FROM blobs WHERE state = 'committed' AND hash = (SELECT max(hash) FROM blobs WHERE state = 'committed')")
def committed_blob_by_hash(lake: Lake) -> DataFrame:
    held = lake.blobs.where("state = 'committed'")
    return held.join(held.agg(F.max("hash").alias("hash")), "hash", "left_semi").select("blob_id")


@query("SELECT * FROM files WHERE legacy_id = 8")
def file_by_legacy_id(lake: Lake) -> DataFrame:
    return lake.files.where("legacy_id = 8")


@query("SELECT count(*) > 0 AS found FROM files WHERE legacy_id = 8")
def legacy_id_exists(lake: Lake) -> DataFrame:
    return lake.files.where("legacy_id = 8").agg((F.count("*") > 0).alias("found"))


@query("""SELECT blob_id, coalesce(state, 'pending') AS state, coalesce(write_owner, '') AS write_owner, coalesce(volume_id, 0) AS volume_id,
  coalesce(blob_offset, 0) AS blob_offset FROM blobs""")
def blob_defaults(lake: Lake) -> DataFrame:
    d = {"state": "pending", "write_owner": "", "volume_id": 0, "blob_offset": 0}
    return lake.blobs.select("blob_id", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in d.items()])


def wanted(lake: Lake) -> DataFrame:
    return lake.files.select(F.col("file_id").alias("request_id"), "blob_id", "name", "legacy_id", "expires_at")


@query("SELECT w.file_id AS request_id, min(f.file_id) AS file_id FROM files w JOIN files f ON w.blob_id = f.blob_id AND w.name = f.name AND w.legacy_id IS NOT DISTINCT FROM f.legacy_id AND w.expires_at IS NOT DISTINCT FROM f.expires_at GROUP BY 1")
def exact_match_nullsafe(lake: Lake) -> DataFrame:
    return c.same_file(lake.files, wanted(lake), True)


@query("SELECT w.file_id AS request_id, min(f.file_id) AS file_id FROM files w JOIN files f ON w.blob_id = f.blob_id AND w.name = f.name AND w.expires_at IS NOT DISTINCT FROM f.expires_at GROUP BY 1")
def auto_match_nullsafe(lake: Lake) -> DataFrame:
    return c.same_file(lake.files, wanted(lake), False)


@query(f"SELECT file_id, blob_id, expires_at FROM files WHERE expires_at IS NOT NULL AND expires_at < TIMESTAMP '{NOW}'")
def expired_files(lake: Lake) -> DataFrame:
    return c.expired(lake.files, NOW).select("file_id", "blob_id", "expires_at")


@query(f"SELECT blob_id FROM blobs b WHERE state = 'pending' AND (write_started_at IS NULL OR write_started_at < TIMESTAMP '{CUTOFF}') AND NOT EXISTS (SELECT 1 FROM files f WHERE f.blob_id = b.blob_id)")
def stale_pending_blobs(lake: Lake) -> DataFrame:
    return c.stale_pending(lake.blobs, lake.files, CUTOFF).select("blob_id")


@query(f"""SELECT blob_id, coalesce(state = 'pending' AND (write_owner IS NULL OR write_owner IN ('', 'worker-1') OR write_started_at IS NULL
  OR write_started_at < TIMESTAMP '{CUTOFF}' - INTERVAL 5 MINUTE), false) AS claimable FROM blobs""")
def claimable_blobs(lake: Lake) -> DataFrame:
    return lake.blobs.select("blob_id", F.coalesce(c.claimable("worker-1", CUTOFF), F.lit(False)).alias("claimable"))


@query("SELECT blob_id, CASE WHEN state IS NULL OR state = '' THEN CASE WHEN coalesce(volume_id, 0) > 0 THEN 'committed' ELSE 'pending' END ELSE state END AS state FROM (SELECT blob_id, volume_id, CASE WHEN blob_id % 4 = 0 THEN NULL WHEN blob_id % 4 = 1 THEN '' ELSE state END AS state FROM blobs)")
def state_backfill(lake: Lake) -> DataFrame:
    old = lake.blobs.withColumn("state", F.when(F.col("blob_id") % 4 == 0, None).when(F.col("blob_id") % 4 == 1, "").otherwise(F.col("state")))
    lost = F.col("state").isNull() | (F.col("state") == "")
    return old.select("blob_id", F.when(lost, F.when(F.coalesce("volume_id", F.lit(0)) > 0, "committed").otherwise("pending")).otherwise(F.col("state")).alias("state"))


@query("SELECT volume_id, size_total, size_deleted FROM volumes WHERE size_total > 0 AND CAST(size_deleted AS DOUBLE) / size_total > 0.09")
def volumes_fragmented(lake: Lake) -> DataFrame:
    return c.fragmented(lake.volumes, 9)


@query("SELECT volume_id, size_total, size_deleted FROM volumes WHERE size_total > 0")
def volumes_all(lake: Lake) -> DataFrame:
    return c.fragmented(lake.volumes, 0)


@query("SELECT volume_id FROM volumes WHERE size_total + 1000 <= 200000")
def volumes_with_room(lake: Lake) -> DataFrame:
    return lake.volumes.where("size_total + 1000 <= 200000").select("volume_id")


@query("SELECT i AS volume_id, coalesce(size_total, 0) AS size_total FROM generate_series(1, 12) AS s(i) LEFT JOIN volumes ON volume_id = i")
def volume_chain(lake: Lake) -> DataFrame:
    """Volumes from the first to the current one; an unknown volume counts as empty."""
    return lake.spark.range(1, 13).select(F.col("id").alias("volume_id")).join(lake.volumes, "volume_id", "left").select("volume_id", F.coalesce("size_total", F.lit(0)).alias("size_total"))


@query("SELECT min(volume_id) AS volume_id FROM volumes WHERE size_total < 250000")
def switch_back_volume(lake: Lake) -> DataFrame:
    return lake.volumes.where("size_total < 250000").agg(F.min("volume_id").alias("volume_id"))


@query("""SELECT f.file_id, f.name, f.blob_id, b.hash, b.size_raw, b.size_compressed, b.compression_alg, t.mime_type, t.category, t.subtype, f.tags
  FROM files f JOIN blobs b ON f.blob_id = b.blob_id JOIN file_types t ON b.file_type_id = t.file_type_id WHERE b.state = 'committed'""")
def file_info(lake: Lake) -> DataFrame:
    found = c.file_info(lake.files, lake.blobs.where("state = 'committed'"), lake.file_types)
    return found.select("file_id", "name", "blob_id", "hash", "size_raw", "size_compressed", "compression_alg", "mime_type", "category", "subtype", "tags")


@query("SELECT count(*) AS n FROM blobs b LEFT JOIN files f ON b.blob_id = f.blob_id WHERE f.blob_id IS NULL")
def orphan_blobs(lake: Lake) -> DataFrame:
    return c.orphan_blobs(lake.blobs, lake.files).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM files f LEFT JOIN blobs b ON f.blob_id = b.blob_id WHERE b.blob_id IS NULL")
def missing_blobs(lake: Lake) -> DataFrame:
    return c.missing_blobs(lake.files, lake.blobs).agg(F.count("*").alias("n"))


@query("SELECT CAST(coalesce(sum(size_compressed), 0) AS BIGINT) AS bytes FROM blobs b LEFT JOIN files f ON b.blob_id = f.blob_id WHERE f.blob_id IS NULL")
def orphan_bytes(lake: Lake) -> DataFrame:
    return c.orphan_blobs(lake.blobs, lake.files).agg(c.zero(F.sum("size_compressed")).alias("bytes"))


@query(""", o AS (SELECT count(*) AS orphan_blobs FROM blobs b ANTI JOIN files f ON b.blob_id = f.blob_id),
m AS (SELECT count(*) AS missing_blobs FROM files f ANTI JOIN blobs b ON f.blob_id = b.blob_id)
SELECT orphan_blobs, missing_blobs, CASE WHEN orphan_blobs > 0 OR missing_blobs > 0 THEN 'warning' ELSE 'ok' END AS status FROM o, m""")
def integrity_quick(lake: Lake) -> DataFrame:
    return c.quick_integrity(lake.files, lake.blobs)


@query("""SELECT r.seq, r.file_id, r.blob_id, b.volume_id, b.blob_offset FROM replay_log r JOIN blobs b ON r.blob_id = b.blob_id""")
def log_probe(lake: Lake) -> DataFrame:
    return lake.replay_log.join(lake.blobs, "blob_id").select("seq", "file_id", "blob_id", "volume_id", "blob_offset")


@query("SELECT count(*) FILTER (WHERE b.blob_id IS NOT NULL) AS kept, count(*) FILTER (WHERE b.blob_id IS NULL) AS orphaned FROM replay_log r LEFT JOIN blobs b ON r.blob_id = b.blob_id")
def log_orphans(lake: Lake) -> DataFrame:
    r, known = lake.replay_log, lake.blobs.select("blob_id", F.lit(True).alias("_known"))
    return r.join(known, "blob_id", "left").agg(F.count("_known").alias("kept"), F.count_if(F.col("_known").isNull()).alias("orphaned"))


@query(""", copies AS (SELECT doc_id AS legacy_id, sha256(CASE WHEN doc_id % 29 = 0 THEN text || 'x' ELSE text END) AS new_hash FROM documents WHERE doc_id % 19 <> 0)
SELECT d.doc_id AS legacy_id, CASE WHEN new_hash IS NULL THEN 'missing' WHEN new_hash <> sha256(text) THEN 'hash_mismatch' ELSE 'match' END AS status
FROM documents d LEFT JOIN copies ON copies.legacy_id = d.doc_id""")
def legacy_verify(lake: Lake) -> DataFrame:
    old = lake.documents.select(F.col("doc_id").alias("legacy_id"), F.sha2("text", 256).alias("old_hash"))
    return verified(old, copied(lake)).select("legacy_id", "status")


def copied(lake: Lake) -> DataFrame:
    text = F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return lake.documents.where("doc_id % 19 <> 0").select(F.col("doc_id").alias("legacy_id"), F.sha2(text, 256).alias("new_hash"))


def verified(old: DataFrame, new: DataFrame) -> DataFrame:
    status = F.when(F.col("new_hash").isNull(), "missing").when(F.col("new_hash") != F.col("old_hash"), "hash_mismatch").otherwise("match")
    return old.join(new, "legacy_id", "left").withColumn("status", status)


@query(""", copies AS (SELECT doc_id AS legacy_id, sha256(CASE WHEN doc_id % 29 = 0 THEN text || 'x' ELSE text END) AS new_hash FROM documents WHERE doc_id % 19 <> 0),
v AS (SELECT d.doc_id AS legacy_id, CASE WHEN new_hash IS NULL THEN 'missing' WHEN new_hash <> sha256(text) THEN 'hash_mismatch' ELSE 'match' END AS status FROM documents d LEFT JOIN copies ON copies.legacy_id = d.doc_id)
SELECT status, count(*) AS total, min(legacy_id) AS first_id, max(legacy_id) AS last_id FROM v WHERE status <> 'match' GROUP BY 1""")
def mismatch_report(lake: Lake) -> DataFrame:
    old = lake.documents.select(F.col("doc_id").alias("legacy_id"), F.sha2("text", 256).alias("old_hash"))
    return verified(old, copied(lake)).where("status <> 'match'").groupBy("status").agg(F.count("*").alias("total"), F.min("legacy_id").alias("first_id"), F.max("legacy_id").alias("last_id"))


@query("""SELECT o.o_orderkey AS file_id, c.c_custkey AS raw_id, o.o_orderpriority AS file_type, string_agg(DISTINCT p.p_brand, ',' ORDER BY p.p_brand) AS labels
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey
WHERE c.c_custkey IS NOT NULL GROUP BY 1, 2, 3""", fixtures=False)
def labels_per_file(lake: Lake) -> DataFrame:
    """Names with their source row and the ordered labels linked to them; null where none are."""
    o, raw = lake.table("orders"), lake.table("customer").select("c_custkey")
    tags = lake.table("lineitem").join(lake.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "p_brand").distinct()
    labels = tags.groupBy("l_orderkey").agg(F.expr("listagg(p_brand, ',') within group (order by p_brand)").alias("labels"))
    return o.join(raw, o.o_custkey == raw.c_custkey).join(labels, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("file_id"), F.col("c_custkey").alias("raw_id"), F.col("o_orderpriority").alias("file_type"), "labels")


@query("SELECT (SELECT count(*) FROM blobs) AS n, CAST((SELECT coalesce(sum(size_compressed), 0) FROM blobs) AS BIGINT) AS compressed, CAST((SELECT coalesce(sum(size_raw), 0) FROM blobs) AS BIGINT) AS raw")
def blob_stats(lake: Lake) -> DataFrame:
    return lake.blobs.agg(F.count("*").alias("n"), c.zero(F.sum("size_compressed")).alias("compressed"), c.zero(F.sum("size_raw")).alias("raw"))


@query("SELECT CAST(coalesce(sum(size_total), 0) AS BIGINT) AS total, CAST(coalesce(sum(size_deleted), 0) AS BIGINT) AS deleted FROM volumes")
def volume_totals(lake: Lake) -> DataFrame:
    return lake.volumes.agg(c.zero(F.sum("size_total")).alias("total"), c.zero(F.sum("size_deleted")).alias("deleted"))


@query("SELECT coalesce(max(legacy_id), 0) AS top FROM files")
def max_legacy_id(lake: Lake) -> DataFrame:
    return lake.files.agg(F.coalesce(F.max("legacy_id"), F.lit(0)).alias("top"))


@query("SELECT legacy_id, count(*) AS n FROM files WHERE legacy_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_legacy_ids(lake: Lake) -> DataFrame:
    return c.duplicate_keys(lake.files, "legacy_id").withColumnRenamed("count", "n")


@query("SELECT DISTINCT volume_id FROM blobs WHERE volume_id IS NOT NULL ORDER BY 1")
def distinct_volumes(lake: Lake) -> DataFrame:
    return lake.blobs.where("volume_id is not null").select("volume_id").distinct().orderBy("volume_id")


@query("SELECT blob_id, count(*) AS refs FROM files GROUP BY 1")
def blob_refcount(lake: Lake) -> DataFrame:
    return lake.files.groupBy("blob_id").agg(F.count("*").alias("refs"))


@query(""", b AS (SELECT count(*) AS blob_count, CAST(coalesce(sum(size_raw), 0) AS BIGINT) AS raw_bytes, CAST(coalesce(sum(size_compressed), 0) AS BIGINT) AS compressed_bytes FROM blobs),
f AS (SELECT count(*) AS file_count FROM files), o AS (SELECT CAST(coalesce(sum(size_compressed), 0) AS BIGINT) AS orphan_bytes FROM blobs ANTI JOIN files USING (blob_id))
SELECT *, file_count - blob_count AS dedup_count, CASE WHEN file_count <> 0 THEN (file_count - blob_count) / file_count * 100 ELSE 0.0 END AS dedup_pct,
CASE WHEN raw_bytes <> 0 THEN (1 - compressed_bytes / raw_bytes) * 100 ELSE 0.0 END AS compression_pct, CASE WHEN compressed_bytes <> 0 THEN orphan_bytes / compressed_bytes * 100 ELSE 0.0 END AS orphan_pct FROM b, f, o""")
def storage_stats(lake: Lake) -> DataFrame:
    return c.storage_stats(lake.files, lake.blobs)


@query("SELECT volume_id, size_total, size_deleted, size_total - size_deleted AS used, CASE WHEN size_total <> 0 THEN size_deleted / size_total * 100 ELSE 0.0 END AS fragmentation_pct FROM volumes")
def volume_report(lake: Lake) -> DataFrame:
    return c.volume_report(lake.volumes)


@query(f"SELECT volume_id, CAST(sum(size_compressed + {OVERHEAD}) AS BIGINT) AS framed, count(*) AS records FROM blobs WHERE volume_id IS NOT NULL GROUP BY 1")
def framed_bytes(lake: Lake) -> DataFrame:
    return c.framed_bytes(lake.blobs)


@query("SELECT volume_id, round(100.0 * size_deleted / size_total, 1) AS fragmentation FROM volumes WHERE size_total > 0")
def space_usage(lake: Lake) -> DataFrame:
    return lake.volumes.where("size_total > 0").select("volume_id", F.round(100.0 * F.col("size_deleted") / F.col("size_total"), 1).alias("fragmentation"))


@query("SELECT CAST(sum(size_total) AS BIGINT) AS total, CAST(sum(size_deleted) AS BIGINT) AS deleted, CAST(sum(size_total - size_deleted) AS BIGINT) AS used FROM volumes")
def space_totals(lake: Lake) -> DataFrame:
    return lake.volumes.agg(F.sum("size_total").alias("total"), F.sum("size_deleted").alias("deleted"), F.sum(F.col("size_total") - F.col("size_deleted")).alias("used"))


@query(""", s AS (SELECT 'files' AS name, count(*) AS source FROM files UNION ALL SELECT 'blobs', count(*) FROM blobs UNION ALL SELECT 'volumes', count(*) FROM volumes),
t AS (SELECT 'files' AS name, count(*) AS target FROM files WHERE legacy_id IS NULL OR legacy_id % 100 <> 3 UNION ALL SELECT 'blobs', count(*) FROM blobs UNION ALL SELECT 'volumes', count(*) FROM volumes)
SELECT name, source, target, source <> target AS mismatch FROM s JOIN t USING (name)""")
def table_counts_verify(lake: Lake) -> DataFrame:
    """Row counts of a copy against its source; the copy of ``files`` lacks some rows."""
    copy = {"files": lake.files.where("legacy_id is null or legacy_id % 100 <> 3"), "blobs": lake.blobs, "volumes": lake.volumes}
    sides = [None, None]
    for k, tables in enumerate(({"files": lake.files, "blobs": lake.blobs, "volumes": lake.volumes}, copy)):
        for name, df in tables.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.col("n").alias(("source", "target")[k]))
            sides[k] = one if sides[k] is None else sides[k].unionAll(one)
    return sides[0].join(sides[1], "name").withColumn("mismatch", F.col("source") != F.col("target"))


@query("SELECT count(*) FILTER (WHERE status = 'completed') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs")
def job_tallies(lake: Lake) -> DataFrame:
    return lake.jobs.agg(F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))


@query(f"SELECT method, {PATH_SQL} AS path, status, count(*) AS n FROM requests WHERE path <> '/metrics' GROUP BY ALL")
def event_counters(lake: Lake) -> DataFrame:
    from cairnlake.functions.text import normal_path

    return lake.requests.where("path <> '/metrics'").groupBy("method", normal_path(F.col("path")).alias("path"), "status").agg(F.count("*").alias("n"))


@query(f"""SELECT method, le, count(*) FILTER (WHERE duration_s <= le) AS n, count(*) AS total, round(sum(duration_s), 6) AS value_sum
FROM requests, (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in BOUNDS)}]) AS le) GROUP BY 1, 2""")
def event_histogram(lake: Lake) -> DataFrame:
    return c.histogram(lake.requests, ["method"], "duration_s", BOUNDS).withColumn("value_sum", F.round("value_sum", 6))


@query("SELECT CAST(sum(size) AS BIGINT) AS bytes_written, count(*) FILTER (WHERE seq <> first_seq) AS dedup_hits FROM (SELECT *, min(seq) OVER (PARTITION BY hash) AS first_seq FROM uploads)")
def byte_counters(lake: Lake) -> DataFrame:
    found = ordered.dedup_assignment(lake.uploads).join(lake.uploads.select("seq", "size"), "seq")
    return found.agg(F.sum("size").alias("bytes_written"), F.count_if("is_dedup").alias("dedup_hits"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS started, count(*) AS errors FROM requests WHERE status >= 400 GROUP BY 1")
def errors_by_five_minutes(lake: Lake) -> DataFrame:
    """Extension: errors counted over windows of five minutes."""
    return lake.requests.where("status >= 400").groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("errors")).select(F.col("w.start").alias("started"), "errors")


@query(f"""SELECT volume_id, blob_id, blob_offset, size_compressed, CAST(coalesce(sum(size_compressed + {OVERHEAD}) OVER (PARTITION BY volume_id ORDER BY blob_offset
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM blobs WHERE volume_id IS NOT NULL""")
def compaction_plan(lake: Lake) -> DataFrame:
    return ordered.compaction_plan(lake.blobs)


@query(f"""SELECT v.volume_id, v.size_total AS before, CAST(coalesce(b.n, 0) AS BIGINT) AS size_total, 0::BIGINT AS size_deleted, CAST(v.size_total - coalesce(b.n, 0) AS BIGINT) AS saved
FROM volumes v LEFT JOIN (SELECT volume_id, sum(size_compressed + {OVERHEAD}) AS n FROM blobs GROUP BY 1) b USING (volume_id) WHERE CAST(size_deleted AS DOUBLE) / v.size_total > 0.09""")
def compact_all(lake: Lake) -> DataFrame:
    """All volumes over the threshold as they are after compaction, and what that saves."""
    after = c.framed_bytes(lake.blobs).select("volume_id", "framed")
    left = F.coalesce("framed", F.lit(0))
    return c.fragmented(lake.volumes, 9).join(after, "volume_id", "left").select("volume_id", F.col("size_total").alias("before"), left.alias("size_total"), F.lit(0).cast("long").alias("size_deleted"), (F.col("size_total") - left).alias("saved"))


@query("SELECT seq, file_id, blob_id, name, tags FROM replay_log QUALIFY row_number() OVER (PARTITION BY blob_id, name ORDER BY seq DESC) = 1")
def log_latest(lake: Lake) -> DataFrame:
    return ordered.latest(lake.replay_log, ["blob_id", "name"], "seq").select("seq", "file_id", "blob_id", "name", "tags")


@query("SELECT owner AS blob_id, max(doc_id) AS last_record FROM hashed GROUP BY 1")
def index_latest(lake: Lake) -> DataFrame:
    """The last index record of each blob wins."""
    rows = lake.hashed.select(F.col("owner").alias("blob_id"), F.col("doc_id").alias("last_record"))
    return ordered.latest(rows, ["blob_id"], "last_record")


@query("SELECT owner AS blob_id, min(doc_id) AS first_record FROM hashed GROUP BY 1")
def blob_first(lake: Lake) -> DataFrame:
    """A rebuild keeps the first record of each blob."""
    rows = lake.hashed.select(F.col("owner").alias("blob_id"), F.col("doc_id").alias("first_record"))
    return ordered.earliest(rows, ["blob_id"], "first_record")


@query("SELECT seq, hash, min(seq) OVER (PARTITION BY hash) AS first_seq, seq <> min(seq) OVER (PARTITION BY hash) AS is_dedup FROM uploads")
def dedup_assignment(lake: Lake) -> DataFrame:
    return ordered.dedup_assignment(lake.uploads)


@query("SELECT seq, (SELECT coalesce(max(legacy_id), 0) FROM uploads) + row_number() OVER (ORDER BY seq) AS legacy_id FROM uploads WHERE legacy_id IS NULL")
def allocate_legacy_ids(lake: Lake) -> DataFrame:
    return ordered.allocate_ids(lake.uploads)


@query(f""", RECURSIVE_MARK AS (SELECT 1), u AS (SELECT seq, size + {OVERHEAD} AS need, row_number() OVER (ORDER BY seq) AS i FROM uploads),
fold AS (SELECT 0::BIGINT AS i, CAST([] AS BIGINT[]) AS used, 0::BIGINT AS seq, 0::BIGINT AS volume_id
 UNION ALL SELECT u.i, CASE WHEN p.at IS NULL THEN list_append(used, need) ELSE list_concat(list_append(used[1:p.at - 1], used[p.at] + need), used[p.at + 1:]) END, u.seq, coalesce(p.at, len(used) + 1)
 FROM fold JOIN u ON u.i = fold.i + 1, LATERAL (SELECT list_position(list_transform(used, lambda x: x + need <= {CAP}), true) AS at) p)
SELECT seq, volume_id FROM fold WHERE i > 0""".replace(", RECURSIVE_MARK AS (SELECT 1)", ""))
def first_fit_placement(lake: Lake) -> DataFrame:
    return ordered.first_fit(lake.uploads, CAP, oversized=True)


@query("SELECT blob_id, volume_id, blob_offset FROM blobs WHERE volume_id IS NOT NULL ORDER BY volume_id, blob_offset, blob_id LIMIT 50 OFFSET 20")
def blobs_page(lake: Lake) -> DataFrame:
    return lake.blobs.where("volume_id is not null").orderBy("volume_id", "blob_offset", "blob_id").offset(20).limit(50).select("blob_id", "volume_id", "blob_offset")


@query("SELECT file_id, name FROM files ORDER BY file_id DESC")
def export_files_desc(lake: Lake) -> DataFrame:
    return lake.files.select("file_id", "name").orderBy(F.desc("file_id"))


@query("SELECT file_id FROM files WHERE name = 'de.txt' ORDER BY file_id LIMIT 1")
def first_file_of_name(lake: Lake) -> DataFrame:
    return lake.files.where("name = 'de.txt'").select("file_id").orderBy("file_id").limit(1)


@query("SELECT job_id, type, status, started_at, CAST(epoch(completed_at) - epoch(started_at) AS BIGINT) AS duration_s FROM jobs ORDER BY started_at DESC, job_id DESC LIMIT 10")
def recent_jobs(lake: Lake) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, started_at, completed_at)")
    return lake.jobs.select("job_id", "type", "status", "started_at", seconds.alias("duration_s")).orderBy(F.desc("started_at"), F.desc("job_id")).limit(10)


@query("SELECT job_id FROM jobs WHERE status IN ('completed', 'failed') AND completed_at < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def evictable_jobs(lake: Lake) -> DataFrame:
    now = lake.table("events").agg(F.max("ts").alias("_now"))
    return lake.jobs.join(F.broadcast(now)).where("status in ('completed', 'failed') and completed_at < _now - interval '1' hour").select("job_id")


@query("SELECT job_id, type, status FROM jobs WHERE job_id = 42")
def job_by_id(lake: Lake) -> DataFrame:
    return lake.jobs.where("job_id = 42").select("job_id", "type", "status")
