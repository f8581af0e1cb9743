"""Queries of whole chains: a batch of uploads, the copy of a catalog between databases, migration and its report."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import text
from cairnlake.operators import migration, uploads
from cairnlake.plans.fixtures import NOW, Lake
from cairnlake.plans.registry import query
from cairnlake.plans.scalars import DECODE_SQL
from cairnlake.schema import OVERHEAD
from cairnlake.session import shared_dir
from cairnlake.sources import jdbc, volumes

#: Bytes that a volume holds, and that one upload may have.
MOST, CAP = 250_000, 30_000
SAME = "{0}.blob_id = {1}.blob_id AND {0}.name = {1}.name AND {0}.expires_at IS NOT DISTINCT FROM {1}.expires_at"
UUID_SQL = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-4' || substr(md5({0}), 14, 3) || '-8' || substr(md5({0}), 18, 3) || '-' || substr(md5({0}), 21, 12)"
UPLOAD_SQL = f""", tested AS (SELECT *, CASE validity WHEN '7 days' THEN TIMESTAMP '{NOW}' + to_days(7) WHEN '1 month' THEN TIMESTAMP '{NOW}' + to_days(30) END AS expires_at,
  validity <> 'bogus' AND strlen(content) <= {CAP} AS valid, sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS size_raw FROM incoming),
held AS (SELECT hash, min(blob_id) AS held, bool_or(state = 'committed') AS done FROM blobs GROUP BY hash),
came AS (SELECT hash, min(seq) AS first FROM tested WHERE valid GROUP BY hash),
fresh AS (SELECT hash, (SELECT max(blob_id) FROM blobs) + row_number() OVER (ORDER BY first) AS new FROM came ANTI JOIN held USING (hash)),
own AS (SELECT t.*, coalesce(held, new) AS blob_id, coalesce(done, false) OR seq <> first AS is_dedup, seq = first AND NOT coalesce(done, false) AS writes, {UUID_SQL.format("request_id")} AS own_id
  FROM tested t JOIN came USING (hash) LEFT JOIN held USING (hash) LEFT JOIN fresh USING (hash) WHERE valid),
holder AS (SELECT * FROM files WHERE legacy_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY legacy_id ORDER BY file_id) = 1),
owner AS (SELECT * FROM own WHERE legacy_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY legacy_id ORDER BY seq) = 1),
explicit AS (SELECT o.request_id, o.seq, o.blob_id, o.name, o.expires_at, o.legacy_id, o.is_dedup, o.tags, o.own_id, h.file_id IS NULL AND w.seq = o.seq AS makes,
  CASE WHEN h.file_id IS NOT NULL THEN CASE WHEN {SAME.format("o", "h")} THEN h.file_id END WHEN {SAME.format("o", "w")} THEN w.own_id END AS met
  FROM own o JOIN owner w USING (legacy_id) LEFT JOIN holder h USING (legacy_id)),
makers AS (SELECT seq, blob_id, name, expires_at, own_id, legacy_id FROM explicit WHERE makes UNION ALL SELECT seq, blob_id, name, expires_at, own_id, NULL FROM own WHERE legacy_id IS NULL),
first_maker AS (SELECT * FROM makers QUALIFY row_number() OVER (PARTITION BY blob_id, name, expires_at ORDER BY seq) = 1),
known AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY blob_id, name, expires_at ORDER BY file_id) = 1),
auto0 AS (SELECT o.request_id, o.seq, o.blob_id, o.name, o.expires_at, o.is_dedup, o.tags, k.file_id IS NULL AND m.seq = o.seq AS makes, coalesce(k.file_id, m.own_id) AS file_id, k.file_id IS NOT NULL AS is_known, k.legacy_id AS known_legacy, m.seq AS maker, m.legacy_id AS maker_legacy
  FROM own o JOIN first_maker m ON {SAME.format("o", "m")} LEFT JOIN known k ON {SAME.format("o", "k")} WHERE o.legacy_id IS NULL),
given AS (SELECT seq AS maker, (SELECT coalesce(max(legacy_id), 0) FROM (SELECT legacy_id FROM files UNION ALL SELECT legacy_id FROM explicit WHERE makes)) + row_number() OVER (ORDER BY seq) AS given FROM auto0 WHERE makes),
told AS (SELECT request_id, CASE WHEN makes OR met IS NOT NULL THEN 200 ELSE 409 END AS status_code, CASE WHEN makes THEN own_id ELSE met END AS file_id, legacy_id, blob_id, is_dedup, makes AS inserted, name, expires_at, tags FROM explicit
  UNION ALL SELECT request_id, 200, file_id, CASE WHEN is_known THEN known_legacy ELSE coalesce(given, maker_legacy) END, blob_id, is_dedup, makes, name, expires_at, tags FROM auto0 LEFT JOIN given USING (maker))
"""


def batch(lake: Lake) -> uploads.Uploaded:
    content_hash = lambda c: F.sha2(c, 256)
    return uploads.uploaded(lake.incoming, lake.files, lake.blobs, lake.volumes, NOW, MOST, CAP, "none", content_hash)


@query(UPLOAD_SQL + """SELECT request_id, status_code, file_id, legacy_id, blob_id, is_dedup, inserted FROM told
UNION ALL SELECT request_id, 400, NULL, NULL, NULL, false, false FROM tested WHERE NOT valid""")
def upload_outcomes(lake: Lake) -> DataFrame:
    return batch(lake).outcomes


@query(UPLOAD_SQL + "SELECT file_id, name, blob_id, legacy_id, expires_at, tags FROM told WHERE inserted")
def upload_files(lake: Lake) -> DataFrame:
    return batch(lake).files.drop("created_at")


@query(UPLOAD_SQL + "SELECT blob_id, hash, size_raw, size_raw AS size_compressed, 'none' AS compression_alg, 'text|plain|text/plain' AS kind FROM own WHERE writes")
def upload_blobs(lake: Lake) -> DataFrame:
    """New blobs; text tells nothing by its bytes, so the type comes from the name."""
    kind = F.when(F.col("kind").rlike(r"^(binary\|Ident|text\|C|binary\|Fake)"), "text|plain|text/plain").otherwise(F.col("kind"))
    return batch(lake).blobs.select("blob_id", "hash", "size_raw", "size_compressed", "compression_alg", kind.alias("kind"))


@query(UPLOAD_SQL + f""", again AS (SELECT file_id, tags FROM told WHERE status_code = 200 AND NOT inserted AND tags <> ''),
sides AS (SELECT file_id, tags FROM again UNION ALL SELECT file_id, tags FROM files SEMI JOIN again USING (file_id) UNION ALL SELECT file_id, tags FROM told SEMI JOIN again USING (file_id) WHERE inserted),
single AS (SELECT DISTINCT file_id, unnest({DECODE_SQL.format('tags')}) AS tag FROM sides)
SELECT file_id, CAST(to_json(list(tag ORDER BY tag)) AS VARCHAR) AS tags FROM single WHERE tag <> '' GROUP BY 1""")
def upload_tags(lake: Lake) -> DataFrame:
    return batch(lake).tags


@query(UPLOAD_SQL + f", fill AS (SELECT CAST(sum(size_total) AS BIGINT) AS held, (SELECT CAST(sum(size_raw + {OVERHEAD}) AS BIGINT) FROM own WHERE writes) AS more FROM volumes) SELECT held + more AS bytes, true AS fits FROM fill")
def upload_volumes(lake: Lake) -> DataFrame:
    """The bytes of all volumes after the batch; none of those that were written to holds more than it may."""
    found = batch(lake)
    fits = found.volumes.join(found.blobs.select("volume_id").distinct(), "volume_id").agg(F.every(F.col("size_total") <= MOST).alias("fits"))
    return found.volumes.agg(F.sum("size_total").alias("bytes")).join(fits)


@query("SELECT doc_id, " + UUID_SQL.format("CAST(doc_id AS VARCHAR)") + " AS id, true AS valid FROM documents", fixtures=False)
def derived_ids(lake: Lake) -> DataFrame:
    made = lake.documents.select("doc_id", uploads.derived_uuid(F.col("doc_id").cast("string")).alias("id"))
    return made.withColumn("valid", F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}$"))


@query("""SELECT 'blobs' AS name, count(*) AS source_rows, count(*) AS target_rows, CAST(max(blob_id) + 1 AS BIGINT) AS next_id, true AS same FROM blobs
UNION ALL SELECT 'volumes', count(*), count(*), CAST(max(volume_id) + 1 AS BIGINT), true FROM volumes""")
def catalog_copy(lake: Lake) -> DataFrame:
    """Tables copied from one database to another; both live in this session's JVM, on the driver's disk."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="catalogs-"))
    source, target = (f"jdbc:derby:{folder}/{x};create=true" for x in ("source", "target"))
    try:
        for name, df in (("blobs", lake.blobs.select("blob_id", "hash", "size_raw")), ("volumes", lake.volumes)):
            jdbc.write_table(df, source, name)
            jdbc.write_table(df.limit(0), target, name)
        jdbc.write_table(lake.volumes.limit(2), target, "volumes")  # what is there already goes
        return jdbc.copy_tables(lake.spark, source, target, {"blobs": "blob_id", "volumes": "volume_id"})
    finally:
        for url in (source, target):
            jdbc.shut(lake.spark, url)
        shutil.rmtree(folder)


MIGRATE_SQL = """, src AS (SELECT doc_id AS raw_id, doc_id + 7000000 AS legacy_id, text, CASE WHEN doc_id % 29 = 0 THEN text || 'x' ELSE text END AS now FROM documents WHERE doc_id % 4 = 2)
"""


def sources(lake: Lake) -> tuple[DataFrame, str]:
    """(rows to migrate, the folder of their packed files); some files are missing."""
    folder = f"{shared_dir(lake.spark)}/sources-{uuid.uuid4().hex}"
    rows = lake.documents.where("doc_id % 4 = 2").select(F.col("doc_id").alias("raw_id"), (F.col("doc_id") + 7_000_000).alias("legacy_id"), F.concat(F.lit("in/"), "lang", F.lit(".txt")).alias("name"), F.col("source").alias("tags"), "text")
    kept = rows.where("raw_id % 19 <> 0").select(text.legacy_path(F.col("raw_id")).alias("path"), F.col("text").cast("binary").alias("content"))
    volumes.write_files(kept, folder, "bz2")
    return rows.drop("text"), folder


@query(MIGRATE_SQL + "SELECT CAST(legacy_id AS BIGINT) AS legacy_id, CASE WHEN raw_id % 19 = 0 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN raw_id % 19 <> 0 THEN sha256(text) END AS hash FROM src")
def migration_requests(lake: Lake) -> DataFrame:
    """Source rows as uploads: contents from packed files by number, names without folders."""
    rows, folder = sources(lake)
    found = migration.requests(rows, folder)
    return found.select("legacy_id", F.when(F.col("content").isNull(), "missing").otherwise("ok").alias("status"), F.sha2("content", 256).alias("hash"))


@query(MIGRATE_SQL + """, v AS (SELECT legacy_id, CASE WHEN raw_id % 19 = 0 THEN 'source_missing' WHEN raw_id % 23 = 0 THEN 'missing' WHEN now <> text THEN 'hash_mismatch' ELSE 'match' END AS status FROM src)
SELECT CAST(legacy_id AS BIGINT) AS legacy_id, status, '{"legacy_id":' || legacy_id || ',"status":"' || status || '"}' AS json FROM v WHERE status <> 'match'""")
def migration_report(lake: Lake) -> DataFrame:
    """Source files against what the store has under their ids, one JSON line for each that differs."""
    rows, folder = sources(lake)
    stored = lake.documents.where("doc_id % 23 <> 0").select((F.col("doc_id") + 7_000_000).alias("legacy_id"), F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return migration.mismatches(migration.requests(rows, folder), stored)


@query(MIGRATE_SQL + ", v AS (SELECT raw_id FROM src ORDER BY raw_id DESC LIMIT 25) SELECT raw_id FROM v")
def migration_slice(lake: Lake) -> DataFrame:
    """The rows to migrate from the last on, so many as the caller asks for."""
    return migration.chosen(sources(lake)[0], reverse=True, limit=25).select("raw_id")
