"""A batch of uploads against the catalog as one chain: check, hash, type, blob, conflict, file, tags, placement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions import media, text
from cairnlake.operators.lifecycle import added
from cairnlake.operators.ordered import first_fit, numbered
from cairnlake.schema import OVERHEAD
from cairnlake.sources import formats
from cairnlake.session import cut

#: Names that files have where their content tells nothing, by extension.
EXTENSIONS = {"txt": "text/plain", "csv": "text/csv", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "pdf": "application/pdf"}
GENERIC = "application/octet-stream"
SAME = ("blob_id", "name", "expires_at")


@dataclass
class Uploaded:
    """What a batch makes: an outcome for each request, new files, written blobs with payload, merged tags, volumes."""

    outcomes: DataFrame
    files: DataFrame
    blobs: DataFrame
    tags: DataFrame
    volumes: DataFrame


def derived_uuid(key: Column) -> Column:
    """A UUID that is the same for the same key, in the form of version 4."""
    h = F.md5(key.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def mime_of(name: Column, declared: Column) -> Column:
    """The declared type, else that of the extension, for content that tells nothing."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    by_name = F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))
    return F.coalesce(F.when((declared != "") & (declared != GENERIC), declared), by_name, F.lit(GENERIC))


def kind_of(content: Column, name: Column, declared: Column) -> Column:
    """``category|subtype|mime`` from the content, or from the declared type or the name where it is generic."""
    found = media.file_type(content)
    mime = mime_of(name, declared)
    parts = F.split(mime, "/")
    return F.when((found == f"binary||{GENERIC}") & (mime != GENERIC), F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), mime)).otherwise(found)


def checked(requests: DataFrame, now: str, cap: int) -> DataFrame:
    """Requests with size_raw, expires_at and ``valid``: a readable validity or none, and content up to ``cap`` bytes."""
    days = text.validity_days(F.col("validity"))
    given = F.coalesce(F.trim("validity"), F.lit("")) != ""
    out = requests.withColumn("size_raw", F.octet_length("content").cast("long")).withColumn("_days", F.when(given, days))
    expires = F.lit(now).cast("timestamp_ntz") + F.expr("make_dt_interval(_days)")
    return out.withColumn("expires_at", expires).withColumn("valid", F.coalesce((~given | days.isNotNull()) & (F.col("size_raw") <= cap), F.lit(False))).drop("_days")


def with_blobs(valid: DataFrame, blobs: DataFrame) -> DataFrame:
    """Valid uploads with blob_id, is_dedup and writes: known contents keep their blob, new ones get the next ids in order of arrival."""
    held = blobs.groupBy("hash").agg(F.min("blob_id").alias("_held"), F.max(F.col("state") == "committed").alias("_done"))
    firsts = cut(valid.groupBy("hash").agg(F.min("seq").alias("_first")).join(held, "hash", "left"))
    top = blobs.agg(F.coalesce(F.max("blob_id"), F.lit(0)).alias("_top"))
    fresh = numbered(firsts.where("_held is null").select("hash", "_first"), "_first", "_n").join(F.broadcast(top)).select("hash", (F.col("_top") + F.col("_n")).alias("_new"))
    own = valid.join(firsts, "hash").join(fresh, "hash", "left")
    first, done = F.col("seq") == F.col("_first"), F.coalesce("_done", F.lit(False))
    return own.withColumns({"blob_id": F.coalesce("_held", "_new"), "is_dedup": done | ~first, "writes": first & ~done}).drop("_held", "_done", "_first", "_new")


def same_key(left: str, right: str) -> Column:
    return (F.col(f"{left}.blob_id") == F.col(f"{right}.blob_id")) & (F.col(f"{left}.name") == F.col(f"{right}.name")) & F.col(f"{left}.expires_at").eqNullSafe(F.col(f"{right}.expires_at"))


def resolved(own: DataFrame, files: DataFrame) -> DataFrame:
    """Each valid upload with status_code, file_id, legacy_id and ``inserted``.

    An explicit legacy id belongs to the file that has it, else to the first upload that names it: another blob, or
    another name or expiry, is a conflict; the same file is met again. An upload without one meets the file of its blob,
    name and expiry, in the catalog or made earlier in the batch, else makes one; it gets the next id after those of the
    catalog and of the batch's explicit ones, in order of arrival. Keys are aggregated before they are joined.
    """
    explicit, auto = own.where("legacy_id is not null"), own.where("legacy_id is null")
    row = lambda *c: F.struct(*c)
    holder = files.where("legacy_id is not null").groupBy("legacy_id").agg(F.min_by(row("file_id", *SAME), F.col("file_id")).alias("_held"))
    owner = explicit.groupBy("legacy_id").agg(F.min_by(row(derived_uuid(F.col("request_id")).alias("file_id"), *SAME), F.col("seq")).alias("_own"), F.min("seq").alias("_first"))
    met = explicit.join(holder, "legacy_id", "left").join(owner, "legacy_id")
    ref = F.coalesce("_held", F.when(F.col("seq") != F.col("_first"), F.col("_own")))
    same = (F.col("_ref.blob_id") == F.col("blob_id")) & (F.col("_ref.name") == F.col("name")) & F.col("_ref.expires_at").eqNullSafe(F.col("expires_at"))
    makes = F.col("_ref").isNull()
    told = met.withColumn("_ref", ref).withColumns({"status_code": F.when(makes | same, 200).otherwise(409), "inserted": makes})
    told = told.withColumn("file_id", F.when(makes, derived_uuid(F.col("request_id"))).when(same, F.col("_ref.file_id"))).drop("_held", "_own", "_first", "_ref")

    makers = told.where("inserted").select(*SAME, "seq", "request_id").unionByName(auto.select(*SAME, "seq", "request_id"))
    first = makers.groupBy(*SAME).agg(F.min("seq").alias("_first"), F.min_by("request_id", "seq").alias("_maker"))
    known = files.groupBy(*SAME).agg(F.min_by(row("file_id", "legacy_id"), F.col("file_id")).alias("_known"))
    a, f, k = auto.alias("a"), first.alias("f"), known.alias("k")
    found = a.join(f, same_key("a", "f")).join(k, same_key("a", "k"), "left").select("a.*", "_first", "_maker", "_known")
    makes = F.col("_known").isNull() & (F.col("seq") == F.col("_first"))
    found = cut(found.withColumns({"status_code": F.lit(200), "inserted": makes, "file_id": F.coalesce("_known.file_id", derived_uuid(F.col("_maker")))}))
    top = files.select("legacy_id").unionAll(told.where("inserted").select("legacy_id")).agg(F.coalesce(F.max("legacy_id"), F.lit(0)).alias("_top"))
    given = numbered(found.where("inserted").select("seq"), "seq", "_n").join(F.broadcast(top)).select(F.col("seq").alias("_first"), (F.col("_top") + F.col("_n")).alias("_given"))
    made = told.where("inserted").select(F.col("seq").alias("_first"), F.col("legacy_id").alias("_made"))
    found = found.join(given, "_first", "left").join(made, "_first", "left")
    found = found.withColumn("legacy_id", F.when(F.col("_known").isNotNull(), F.col("_known.legacy_id")).otherwise(F.coalesce("_given", "_made"))).drop("_first", "_maker", "_known", "_given", "_made")
    return told.unionByName(found)


def merged_tags(told: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, tags) of the files that uploads met again with tags: theirs and the uploads', each once, sorted."""
    again = told.where("status_code = 200 and not inserted").select("file_id", "tags")
    base = files.select("file_id", "tags").unionAll(told.where("inserted").select("file_id", "tags"))
    wanted = again.where("tags <> ''").select("file_id").distinct()
    each = base.join(wanted, "file_id", "left_semi").unionAll(again.where("tags <> ''"))
    single = each.select("file_id", F.explode(text.decode_tags(F.col("tags"))).alias("_tag")).where("_tag <> ''").distinct()
    return single.groupBy("file_id").agg(text.encode_tags(F.sort_array(F.collect_list("_tag"))).alias("tags"))


def uploaded(requests: DataFrame, files: DataFrame, blobs: DataFrame, volumes: DataFrame, now: str, most: int, cap: int, mode: str = "auto", hasher: Callable[[Column], Column] = formats.blake2b) -> Uploaded:
    """A batch of (request_id, seq, name, content, content_type, legacy_id, validity, tags) in the order of ``seq``.

    Bad requests (400) and conflicts (409) make no file; a conflict's content is stored all the same. Contents that no
    committed blob has are packed and placed: each in the lowest volume with room, after what that holds. Of the contents
    only the written ones move beyond the hash join.
    """
    tested = checked(requests, now, cap).withColumn("hash", hasher(F.col("content")))
    own = cut(with_blobs(tested.where("valid").drop("content"), blobs))
    told = cut(resolved(own, files))
    bad = tested.where("not valid").select("request_id", F.lit(400).alias("status_code"), F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("long").alias("legacy_id"), F.lit(None).cast("long").alias("blob_id"), F.lit(False).alias("is_dedup"), F.lit(False).alias("inserted"))
    outcomes = told.select(*bad.columns).unionByName(bad)

    contents = requests.select("seq", "content", "content_type").join(own.where("writes").select("seq", "blob_id", "hash", "name", "size_raw"), "seq")
    wanted = F.lit("zstd" if mode == "auto" else mode)
    packed = contents.withColumn("_packed", formats.pack(F.col("content"), wanted)).withColumn("compression_alg", media.compression(F.lit(mode), F.col("size_raw"), F.octet_length("_packed")))
    payload = F.when(F.col("compression_alg") == "none", F.col("content")).otherwise(F.col("_packed"))
    rows = cut(packed.select("seq", "blob_id", "hash", "size_raw", "compression_alg", kind_of(F.col("content"), F.col("name"), F.col("content_type")).alias("kind"), payload.alias("payload")).withColumn("size_compressed", F.octet_length("payload").cast("long")))
    place = cut(first_fit(rows.select("seq", F.col("size_compressed").alias("size")), most, True, volumes))
    before = Window.partitionBy("volume_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # one volume's new records
    offset = F.coalesce("size_total", F.lit(0)) + F.coalesce(F.sum(F.col("size_compressed") + OVERHEAD).over(before), F.lit(0))
    written = rows.join(place, "seq").join(volumes.select("volume_id", "size_total"), "volume_id", "left").withColumn("blob_offset", offset).drop("size_total")
    grown = added(volumes, written.select("volume_id", (F.col("size_compressed") + OVERHEAD).alias("size_total")), "volume_id", "size_total")
    fresh = told.where("inserted").select("file_id", "name", "blob_id", "legacy_id", F.lit(now).cast("timestamp_ntz").alias("created_at"), "expires_at", "tags")
    return Uploaded(outcomes, fresh, written.withColumn("state", F.lit("committed")), merged_tags(told, files), grown)
