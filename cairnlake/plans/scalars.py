"""Queries of the scalar functions, over columns of the driver's tables or small lists of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import media, text
from cairnlake.plans.fixtures import Lake
from cairnlake.plans.registry import PATH_SQL, query
from cairnlake.schema import ALGORITHMS

SIZES = ["10MB", "1 g", "512K", "7", " 3 kb ", "2GB", "1.5MB", "1TB", "10B", "", "x", "-4K", "5 M"]
VALIDITIES = ["1 day", "365 days", "12 months", "3 Months", "0 day", "366 days", "13 months", "2 weeks", "1 hour", "day", "  2   days "]
TAGS = ["", '["a","b"]', "x, y ,,z", "[bad", "[]", '["q"]', "one"]
SAMPLES = [s for s, *_ in media.SIGNATURES] + [
    "524946460000000057454250", "5249464600000000574542", "3C7376673E", "3C3F786D6C", b"gaia_fake_file".hex().upper(), (b"gaia_fake_file" + b" " * 120).hex().upper(),
    b"sep=,Service Tool INSITE ECM Code".hex().upper(), b"sep=,Service Tool".hex().upper(), b"Software Group Part Number C7.1".hex().upper(), b"Software Group Part Number X".hex().upper(),
    b"the IDENT word".hex().upper(), b"ident but fake".hex().upper(), (b"ident" + b" " * 11995).hex().upper(), b"plain".hex().upper(), "",
]
KEYS = [("db_password", "x"), ("api_key", "y"), ("key_path", "/k"), ("token", ""), ("port", "80")]
DSNS = ["postgres://u:p@h/db", "no-at", "://@x", "mysql://h/db"]
TIMES = ["2024-01-02 03:04:05", "2024-01-02T03:04:05.5", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05+02:00", "1700000000", "", "soon"]


def values(rows: list, names: str) -> str:
    """A DuckDB table of the rows."""

    def lit(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") AS t({names})"


def cases(lake: Lake, rows: list, schema: str) -> DataFrame:
    return lake.spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


@query("SELECT doc_id, sha256(text) AS hash FROM documents", fixtures=False)
def sha256_content(lake: Lake) -> DataFrame:
    return lake.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT doc_id, to_base64(encode(text)) AS body FROM documents", fixtures=False)
def base64_content(lake: Lake) -> DataFrame:
    """Whole contents, of any length."""
    return lake.documents.select("doc_id", F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "").alias("body"))


@query("""SELECT blob_id, m AS mode, CASE WHEN m = 'auto' THEN CASE WHEN size_raw <> 0 AND (size_raw - size_compressed) / size_raw * 100 >= 10 THEN 'zstd' ELSE 'none' END WHEN m IN ('gzip', 'zstd') THEN m ELSE 'none' END AS algorithm
FROM blobs, (SELECT unnest(['auto', 'gzip', 'zstd', 'force']) AS m)""")
def compression_decision(lake: Lake) -> DataFrame:
    modes = F.explode(F.array(*map(F.lit, ("auto", "gzip", "zstd", "force"))))
    return lake.blobs.select("blob_id", modes.alias("mode"), "size_raw", "size_compressed").select("blob_id", "mode", media.compression(F.col("mode"), F.col("size_raw"), F.col("size_compressed")).alias("algorithm"))


@query("SELECT blob_id, CASE compression_alg WHEN 'gzip' THEN 1 WHEN 'zstd' THEN 2 ELSE 0 END AS code FROM blobs")
def algorithm_codes(lake: Lake) -> DataFrame:
    code = F.lit(0)
    for name, n in ALGORITHMS.items():
        code = F.when(F.col("compression_alg") == name, n).otherwise(code)
    return lake.blobs.select("blob_id", code.alias("code"))


MAGIC_SQL = " ".join(f"WHEN starts_with(h, '{p}') THEN '{k}|{s}|{m}'" for p, k, s, m in media.SIGNATURES)


def hexed(s: str) -> str:
    return s.encode().hex().upper()


@query(f"""SELECT h, CASE {MAGIC_SQL} WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'image|WebP|image/webp'
WHEN contains(left(t, 100), '<svg') OR contains(left(t, 100), '<?xml') THEN 'image|SVG|image/svg+xml'
WHEN n < 120 AND contains(t, 'gaia_fake_file') THEN 'binary|Fake|application/octet-stream'
WHEN starts_with(t, 'sep=,') AND contains(left(t, 1000), 'Service Tool') AND contains(left(t, 1000), 'INSITE') AND contains(left(t, 1000), 'ECM Code') THEN 'text|Cummins|text/csv'
WHEN contains(left(t, 1000), 'Software Group Part Number') AND regexp_matches(left(t, 1000), 'C\\d+(\\.\\d+)?') THEN 'text|CAT|text/plain'
WHEN n < 12000 AND contains(lower(t), 'ident') AND NOT contains(lower(t), 'fake') THEN 'binary|Ident|application/octet-stream'
ELSE 'binary||application/octet-stream' END AS kind
FROM (SELECT h, len(h) // 2 AS n, CASE WHEN regexp_matches(h, '^([2-7][0-9A-F])*$') THEN decode(unhex(h)) ELSE '' END AS t FROM {values(SAMPLES, "h")})""", fixtures=False)
def file_type_detect(lake: Lake) -> DataFrame:
    return cases(lake, SAMPLES, "h string").select("h", media.file_type(F.unhex("h")).alias("kind"))


@query("""SELECT blob_id, mime_type, CASE WHEN regexp_matches(mime_type, '^(image|video|audio)/') OR mime_type IN ('application/pdf', 'text/plain') THEN 'inline' ELSE 'attachment' END AS disposition,
starts_with(mime_type, 'image/') AS is_image, mime_type = 'application/pdf' AS is_pdf, CASE WHEN contains(mime_type, 'png') THEN 'image/png' ELSE 'image/jpeg' END AS output_type FROM blobs JOIN file_types USING (file_type_id)""")
def content_headers(lake: Lake) -> DataFrame:
    m = F.col("mime_type")
    return lake.blobs.join(lake.file_types, "file_type_id").select("blob_id", "mime_type", media.disposition(m).alias("disposition"), m.startswith("image/").alias("is_image"), (m == "application/pdf").alias("is_pdf"), media.image_output(m).alias("output_type"))


@query(f"SELECT s, CASE WHEN x <> '' THEN CAST(x AS BIGINT) * CASE u WHEN 'G' THEN 1073741824 WHEN 'M' THEN 1048576 WHEN 'K' THEN 1024 ELSE 1 END END AS bytes FROM (SELECT s, regexp_extract(upper(trim(s)), '^([+-]?[0-9]{{1,18}})\\s*(?:[GMK]B?)?$', 1) AS x, regexp_extract(upper(trim(s)), '([GMK])B?$', 1) AS u FROM {values(SIZES, 's')})", fixtures=False)
def parse_bytes(lake: Lake) -> DataFrame:
    return cases(lake, SIZES, "s string").select("s", text.parse_bytes(F.col("s")).alias("bytes"))


@query(f"""SELECT s, CASE WHEN len(p) = 2 AND d BETWEEN 1 AND 365 THEN TIMESTAMP '2024-01-01' + to_days(d) END AS expires FROM
(SELECT s, p, CASE WHEN starts_with(lower(p[2]), 'day') THEN try_cast(p[1] AS INT) WHEN starts_with(lower(p[2]), 'month') THEN try_cast(p[1] AS INT) * 30 END AS d
 FROM (SELECT s, string_split(regexp_replace(trim(s), '\\s+', ' ', 'g'), ' ') AS p FROM {values(VALIDITIES, 's')}))""", fixtures=False)
def parse_validity(lake: Lake) -> DataFrame:
    days = text.validity_days(F.col("s"))
    return cases(lake, VALIDITIES, "s string").withColumn("d", days).select("s", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(d)")).alias("expires"))


SIZE_SQL = "CASE " + " ".join(f"WHEN n >= {1 << 10 * k} THEN printf('%.1f', n / {1 << 10 * k}.0) || ' {u}B'" for k, u in reversed([*enumerate("KMGTPE", 1)])) + " ELSE n || ' B' END"
SHORT_SQL = "CASE " + " ".join(f"WHEN n >= {1 << 10 * k} THEN regexp_replace(printf('%.2f', n / {1 << 10 * k}.0), '\\.?0+$', '') || ' {u}'" for k, u in reversed([*enumerate(("KB", "MB", "GB", "TB"), 1)])) + " ELSE n || ' B' END"


@query(f"SELECT n, {SIZE_SQL} AS long_form, {SHORT_SQL} AS short_form FROM (SELECT size_raw * (1 + blob_id % 7 * 100000) AS n FROM blobs)")
def format_bytes(lake: Lake) -> DataFrame:
    n = F.col("n")
    return lake.blobs.select((F.col("size_raw") * (1 + F.col("blob_id") % 7 * 100_000)).alias("n")).select("n", text.format_bytes(n).alias("long_form"), text.format_bytes_short(n).alias("short_form"))


DECODE_SQL = """CASE WHEN {0} = '' THEN NULL WHEN regexp_matches(trim({0}), '^\\[\\s*(?:"(?:[^"\\\\]|\\\\.)*"\\s*(?:,\\s*"(?:[^"\\\\]|\\\\.)*"\\s*)*)?\\]$') THEN regexp_extract_all({0}, '"((?:[^"\\\\]|\\\\.)*)"', 1)
ELSE list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: x <> '') END"""


@query(f"SELECT s, array_to_string({DECODE_SQL.format('s')}, '|') AS tags FROM (SELECT s FROM {values(TAGS, 's')} UNION ALL SELECT DISTINCT tags FROM files)")
def tags_decode(lake: Lake) -> DataFrame:
    rows = cases(lake, TAGS, "s string").unionAll(lake.files.select("tags").distinct())
    return rows.select("s", F.array_join(text.decode_tags(F.col("s")), "|").alias("tags"))


@query(f"""SELECT file_id, CASE WHEN tags = '' THEN more WHEN more = '' THEN tags ELSE CAST(to_json(list_sort(list_distinct(list_concat({DECODE_SQL.format('tags')}, {DECODE_SQL.format('more')})))) AS VARCHAR) END AS merged
FROM (SELECT file_id, tags, CASE WHEN legacy_id % 3 = 0 THEN '' ELSE '["new","en"]' END AS more FROM files)""")
def tags_merge(lake: Lake) -> DataFrame:
    rows = lake.files.select("file_id", "tags", F.when(F.col("legacy_id") % 3 == 0, "").otherwise('["new","en"]').alias("more"))
    return rows.select("file_id", text.merge_tags(F.col("tags"), F.col("more")).alias("merged"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '[\"' || lang || '\",\"' || source || '\"]' END AS tags FROM documents", fixtures=False)
def tags_encode(lake: Lake) -> DataFrame:
    tags = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    return lake.documents.select("doc_id", text.encode_tags(tags).alias("tags"))


@query(f"SELECT DISTINCT path AS raw, {PATH_SQL} AS path FROM requests")
def normalize_path(lake: Lake) -> DataFrame:
    return lake.requests.select(F.col("path").alias("raw")).distinct().withColumn("path", text.normal_path(F.col("raw")))


@query("SELECT doc_id, (doc_id - doc_id % 1000) || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.bz2' AS path, lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.bz2' AS base FROM documents", fixtures=False)
def legacy_path(lake: Lake) -> DataFrame:
    return lake.documents.select("doc_id", text.legacy_path(F.col("doc_id")).alias("path")).withColumn("base", text.basename(F.col("path")))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(url_encode(url), '%24', '$'), '%26', '&'), '%2B', '+'), '%3D', '='), '%3A', ':'), '%40', '@') AS escaped FROM pages", fixtures=False)
def path_escape(lake: Lake) -> DataFrame:
    return lake.table("pages").select("page_id", text.path_escape(F.col("url")).alias("escaped"))


@query("""SELECT o_orderkey, CASE WHEN w <= m AND h <= m THEN w ELSE CAST(trunc(w * least(m / w, m / h)) AS INT) END AS width, CASE WHEN w <= m AND h <= m THEN h ELSE CAST(trunc(h * least(m / w, m / h)) AS INT) END AS height,
CASE WHEN m <= 150 THEN 85 WHEN m <= 400 THEN 88 ELSE 90 END AS quality FROM (SELECT o_orderkey, CAST(1 + o_custkey % 3000 AS INT) AS w, CAST(1 + o_orderkey % 2000 AS INT) AS h, unnest([150, 400, 800, 1200]) AS m FROM orders)""", fixtures=False)
def fit_dims(lake: Lake) -> DataFrame:
    rows = lake.table("orders").select("o_orderkey", (1 + F.col("o_custkey") % 3000).cast("int").alias("w"), (1 + F.col("o_orderkey") % 2000).cast("int").alias("h"), F.explode(F.array(*map(F.lit, media.VARIANTS.values()))).alias("m"))
    w, h = media.fitted(F.col("w"), F.col("h"), F.col("m"), F.col("m"))
    return rows.select("o_orderkey", w.alias("width"), h.alias("height"), media.image_quality(F.col("m")).alias("quality"))


@query("SELECT file_id, v AS variant, '\"' || file_id || '-' || v || '\"' AS etag, CASE v WHEN 'thumb' THEN 150 WHEN 'sm' THEN 400 WHEN 'md' THEN 800 WHEN 'lg' THEN 1200 END AS side FROM files, (SELECT unnest(['', 'thumb', 'sm', 'md', 'lg']) AS v)")
def image_variants(lake: Lake) -> DataFrame:
    side = F.lit(None).cast("int")
    for name, n in media.VARIANTS.items():
        side = F.when(F.col("variant") == name, n).otherwise(side)
    rows = lake.files.select("file_id", F.explode(F.array(*map(F.lit, ("", *media.VARIANTS)))).alias("variant"))
    return rows.select("file_id", "variant", F.concat(F.lit('"'), "file_id", F.lit("-"), "variant", F.lit('"')).alias("etag"), side.alias("side"))


@query(f"SELECT k, CASE WHEN v <> '' AND (regexp_matches(k, 'password|passwd|secret|token') OR contains(k, 'key') AND NOT contains(k, 'key_path')) THEN '********' ELSE v END AS shown FROM {values(KEYS, 'k, v')}", fixtures=False)
def mask_secrets(lake: Lake) -> DataFrame:
    return cases(lake, KEYS, "k string, v string").select("k", text.secret_masked(F.col("k"), F.col("v")).alias("shown"))


@query(f"SELECT d, CASE WHEN strpos(d, '@') = 0 OR strpos(d, '://') = 0 OR strpos(d, '@') <= strpos(d, '://') + 3 THEN d ELSE substr(d, 1, strpos(d, '://') + 2) || '****:****' || substr(d, strpos(d, '@')) END AS shown FROM {values(DSNS, 'd')}", fixtures=False)
def mask_dsn(lake: Lake) -> DataFrame:
    return cases(lake, DSNS, "d string").select("d", text.dsn_masked(F.col("d")).alias("shown"))


@query("""SELECT event_id, '{"time":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","level":"' || CASE event_id % 4 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARN' ELSE 'ERROR' END || '","category":"' || upper(event_type) || '","message":"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '"}' AS line FROM events WHERE event_id % 4 >= 2""", fixtures=False)
def log_lines(lake: Lake) -> DataFrame:
    """Log lines of the level WARN and above, as JSON."""
    level = F.element_at(F.array(*map(F.lit, ("DEBUG", "INFO", "WARN", "ERROR"))), (F.col("event_id") % 4 + 1).cast("int"))
    parts = ('{"time":"', F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), '","level":"', level, '","category":"', F.upper("event_type"), '","message":"', text.json_escaped(F.col("props")), '"}')
    return lake.table("events").where("event_id % 4 >= 2").select("event_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))


@query(f"""SELECT s, CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d\\d-\\d\\d[ T]') THEN CASE WHEN regexp_matches(s, '(Z|[+-]\\d\\d:\\d\\d)$') THEN CAST(s AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE CAST(s AS TIMESTAMP) END
WHEN regexp_matches(s, '^[+-]?\\d+$') THEN make_timestamp(CAST(s AS BIGINT) * 1000000) END AS moment FROM {values(TIMES, 's')}""", fixtures=False)
def timestamp_normalise(lake: Lake) -> DataFrame:
    return cases(lake, TIMES, "s string").select("s", text.timestamp_of(F.col("s")).alias("moment"))


@query("SELECT volume_id, greatest(size_total - 200000, 0) AS left_over, greatest(size_total, size_deleted) AS larger FROM volumes")
def clamped_sizes(lake: Lake) -> DataFrame:
    return lake.volumes.select("volume_id", F.greatest(F.col("size_total") - 200_000, F.lit(0)).alias("left_over"), F.greatest("size_total", "size_deleted").alias("larger"))


@query("SELECT page_id, try_cast(regexp_extract(url, 'page=(\\d+)', 1) AS BIGINT) AS page, contains(url, 'https') AS secure FROM pages", fixtures=False)
def request_params(lake: Lake) -> DataFrame:
    return lake.table("pages").select("page_id", F.regexp_extract("url", r"page=(\d+)", 1).try_cast("long").alias("page"), F.col("url").contains("https").alias("secure"))


@query("SELECT name, split_part(name, '.', 2) AS extension, CASE split_part(name, '.', 2) WHEN 'txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM files GROUP BY 1")
def mime_fallback(lake: Lake) -> DataFrame:
    """The mime type by extension, where nothing better is known."""
    known = F.create_map(*[F.lit(x) for kv in {"txt": "text/plain", "png": "image/png", "pdf": "application/pdf"}.items() for x in kv])
    extension = F.split_part("name", F.lit("."), F.lit(2))
    return lake.files.groupBy("name").agg(F.count("*").alias("n")).select("name", extension.alias("extension"), F.coalesce(F.try_element_at(known, extension), F.lit("application/octet-stream")).alias("mime"), "n")
