"""The store's capabilities over catalog tables and a folder of volumes, as methods that return DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators import catalog, lifecycle, ordered, recovery, uploads
from cairnlake.sources import formats, volumes


@dataclass
class Engine:
    """A catalog (files, blobs, volumes, file types) and the folder that its volumes lie in."""

    files: DataFrame
    blobs: DataFrame
    volumes: DataFrame
    types: DataFrame
    folder: str

    def upload(self, requests: DataFrame, now: str, most: int, cap: int, mode: str = "auto") -> uploads.Uploaded:
        """Outcomes and new rows of a batch, whose payloads are written to the volumes; only then the rows are to be stored."""
        done = uploads.uploaded(requests, self.files, self.blobs, self.volumes, now, most, cap, mode)
        rows = done.blobs.select("volume_id", "blob_id", F.col("compression_alg").alias("algorithm"), "payload")
        volumes.write_volumes(rows, self.folder, self.volumes).collect()
        return done

    def info(self, wanted: DataFrame) -> DataFrame:
        """Files of ``wanted`` (file_id, or legacy_id) with their blob and type."""
        key = "file_id" if "file_id" in wanted.columns else "legacy_id"
        return catalog.file_info(self.files.join(wanted.select(key), key, "left_semi"), self.blobs.where("state = 'committed'"), self.types)

    def download(self, wanted: DataFrame) -> DataFrame:
        """``info`` with ``content``; null where the record can't be read."""
        found = self.info(wanted)
        read = volumes.read_blobs(self.blobs.join(found.select("blob_id"), "blob_id", "left_semi"), self.folder, True).select("blob_id", "payload")
        return found.join(read, "blob_id", "left").withColumn("content", formats.unpack(F.col("payload"), F.col("compression_alg"))).drop("payload")

    def delete(self, wanted: DataFrame) -> Engine:
        """The catalog without the files of ``wanted`` (file_id) and without the blobs that only they used."""
        files, blobs, held = lifecycle.deleted(self.files, self.blobs, self.volumes, wanted)
        return Engine(files, blobs, held, self.types, self.folder)

    def stats(self) -> DataFrame:
        return catalog.storage_stats(self.files, self.blobs)

    def volume_report(self) -> DataFrame:
        return catalog.volume_report(self.volumes)

    def fragmented(self, percent: float) -> DataFrame:
        return catalog.fragmented(self.volumes, percent)

    def compaction_plan(self) -> DataFrame:
        return ordered.compaction_plan(self.blobs)

    def compact(self, percent: float) -> DataFrame:
        """Rewrites the volumes of which more than ``percent`` is deleted; the blobs' new offsets."""
        return volumes.compact_volumes(self.blobs.join(self.fragmented(percent).select("volume_id"), "volume_id", "left_semi"), self.folder)

    def integrity(self, deep: bool = False) -> DataFrame:
        return recovery.deep_integrity(self.blobs, self.files, self.folder) if deep else catalog.quick_integrity(self.files, self.blobs)
