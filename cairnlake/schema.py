"""Constants and schemas of the catalog and of its binary records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The record formats.
MAGIC = 0x43554D55
VERSION = 1
HEADER, FOOTER = 22, 4
OVERHEAD = HEADER + FOOTER
INDEX_RECORD = 29
ALGORITHMS = {"none": 0, "gzip": 1, "zstd": 2}

FILES = "file_id string, name string, blob_id bigint, legacy_id bigint, created_at timestamp_ntz, expires_at timestamp_ntz, tags string"
BLOBS = "blob_id bigint, hash string, state string, write_owner string, write_started_at timestamp_ntz, volume_id bigint, blob_offset bigint, size_raw bigint, size_compressed bigint, compression_alg string, file_type_id bigint"
VOLUMES = "volume_id bigint, size_total bigint, size_deleted bigint"
FILE_TYPES = "file_type_id bigint, mime_type string, category string, subtype string"


def has_column(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}


def migrated(df: DataFrame, ddl: str) -> DataFrame:
    """A table of an older schema in the columns, types and order of ``ddl``; columns that it lacks are null, others go."""
    wanted = StructType.fromDDL(ddl)
    return df.select(*[(F.col(f.name) if has_column(df, f.name) else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
