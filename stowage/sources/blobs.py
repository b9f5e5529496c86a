"""A blob store: keys to bytes, as a log of puts and deletes that only grows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest_wins


@dataclass
class BlobStore:
    """Blobs in a folder of batches; of several entries of a key the one of the highest batch counts."""

    spark: SparkSession
    folder: str

    def put(self, blobs: DataFrame, batch: int) -> None:
        """Store (key, data) as one batch; trying a batch again replaces it."""
        rows = blobs.select("key", "data", F.length("data").cast("long").alias("size"), F.lit(False).alias("gone"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def delete(self, keys: DataFrame, batch: int) -> None:
        """Take keys away, as one batch."""
        rows = keys.select("key", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("gone"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def stat(self) -> DataFrame:
        """(key, size, batch) of what is there, without reading any data."""
        log = self.spark.read.parquet(self.folder).select("key", "size", "gone", "batch")
        return latest_wins(log, ["key"], ["batch"]).where("NOT gone").drop("gone")

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, data) of those keys that are there."""
        wanted = self.stat().join(keys.select("key").distinct(), "key", "left_semi")
        return self.spark.read.parquet(self.folder).join(wanted.select("key", "batch"), ["key", "batch"], "left_semi").select("key", "data")

    def get_ranges(self, ranges: DataFrame) -> DataFrame:
        """Ranges (key, offset, length) with their data; shorter where a blob ends, none where there is none."""
        data = F.substring("data", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
        return ranges.join(self.get(ranges), "key").select("key", "offset", "length", data.alias("data"))


def hosted_items(requested: DataFrame, stored: DataFrame, prefix: str = "peer_") -> tuple[DataFrame, DataFrame]:
    """(hash, data) of requested hashes that are hosted for a peer, under the key ``prefix`` and hash, and the hashes that aren't."""
    wanted = requested.select("hash").distinct().withColumn("key", F.concat(F.lit(prefix), "hash"))
    found = wanted.join(stored.select("key", "data"), "key").select("hash", "data")
    return found, wanted.join(stored.select("key"), "key", "left_anti").select("hash")
