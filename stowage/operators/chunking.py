"""Fixed-size chunks of contents, and their reassembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import join_bytes
from ..functions.paths import content_hash

CHUNK = 4 << 20
#: Names bytes by their hash: ``content_hash`` (SHA-256, built in) or ``blake3``.
HashOf = Callable[[Column], Column]


def chunk(rows: DataFrame, keys: list[str], data: str, size: int = CHUNK) -> DataFrame:
    """Keys with sequence (from 0), data and length of each chunk; the last may be short, empty data has none."""
    length = F.length(data)
    at = F.sequence(F.lit(0), F.floor((length - 1) / size).cast("int"))
    parts = rows.where(length > 0).select(*keys, data, F.explode(at).alias("sequence"))
    piece = F.substring(F.col(data), F.col("sequence") * size + 1, F.lit(size))
    return parts.select(*keys, "sequence", piece.alias("data"), F.length(piece).cast("long").alias("length"))


def manifest(chunks: DataFrame, keys: list[str], hash_of: HashOf = content_hash) -> DataFrame:
    """Keys, sequence, hash and length: what a version refers to, without the bytes."""
    return chunks.select(*keys, "sequence", hash_of(F.col("data").cast("binary")).alias("hash"), "length")


def valid(rows: DataFrame, data: Column, claimed: Column, hash_of: HashOf = content_hash) -> tuple[DataFrame, DataFrame]:
    """Rows whose data has the claimed hash, and those to quarantine (a null claim is wrong)."""
    same = F.coalesce(hash_of(data) == claimed, F.lit(False))
    return rows.where(same), rows.where(~same)


def require_valid(rows: DataFrame, data: Column, claimed: Column, hash_of: HashOf = content_hash) -> DataFrame:
    """All rows; one whose data hasn't the claimed hash fails the query."""
    same = F.coalesce(hash_of(data) == claimed, F.lit(False))
    return rows.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("content doesn't match its hash "), F.coalesce(claimed, F.lit("null")))).cast("boolean")))


def reassemble(parts: DataFrame, keys: list[str], order: str = "sequence", data: str = "data") -> DataFrame:
    """Keys and content: the parts joined in order. A file's parts are one output value, so they meet in one task."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    grouped = parts.groupBy(*keys).agg(ordered.alias("_parts"))
    pieces = F.transform("_parts", lambda p: p["d"])
    joined = F.array_join(pieces, "") if parts.schema[data].dataType.simpleString() == "string" else join_bytes(pieces)
    return grouped.select(*keys, joined.alias("content"))


def needed(offer: DataFrame, existing: DataFrame) -> DataFrame:
    """Positions of an offer (position, hash) that the store lacks; a hash repeated in the offer keeps all its positions."""
    return offer.join(existing.select("hash").distinct(), "hash", "left_anti")


def needed_indices(batches: DataFrame, existing: DataFrame) -> DataFrame:
    """(batch, needed): for each batch of an array column ``hashes`` the ascending positions the store lacks."""
    offered = batches.select("batch", F.posexplode("hashes").alias("position", "hash"))
    lacking = needed(offered, existing).groupBy("batch").agg(F.array_sort(F.collect_list("position")).alias("needed"))
    return batches.select("batch").join(lacking, "batch", "left").select("batch", F.coalesce("needed", F.array().cast("array<int>")).alias("needed"))


def batch_duplicates(offer: DataFrame) -> DataFrame:
    """Adds duplicate: the hash stands at an earlier position of the same batch."""
    first = offer.groupBy("batch", "hash").agg(F.min("position").alias("_first"))
    return offer.join(first, ["batch", "hash"]).withColumn("duplicate", F.col("position") > F.col("_first")).drop("_first")


def dedup(blobs: DataFrame, hash_column: str, order: str, size: str) -> DataFrame:
    """One row per hash: first occurrence, number of references, size."""
    return blobs.groupBy(hash_column).agg(F.min(order).alias("first_" + order), F.count("*").alias("refs"), F.max(size).alias("size"))


def savings(blobs: DataFrame, group: str, hash_column: str, size: str) -> DataFrame:
    """Per group: bytes, unique bytes and their ratio (null without bytes)."""
    by_hash = blobs.groupBy(group, hash_column).agg(F.count("*").alias("n"), F.max(size).alias("s"))
    total, unique = F.sum(F.col("n") * F.col("s")), F.sum("s")
    return by_hash.groupBy(group).agg(total.alias("total_bytes"), unique.alias("unique_bytes"), F.round(F.try_divide(unique, total), 6).alias("ratio"))


def download(requested: DataFrame, locations: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, content) of requested hashes by their locations in order, and the hashes that are missing.

    ``pieces`` has shard_id, piece_index and data; a location is a byte range of
    a piece. A hash is missing if it has no location or one of its ranges isn't there.
    """
    wanted = requested.select("hash").distinct()
    ranges = wanted.join(locations.withColumnRenamed("blob_hash", "hash"), "hash").join(pieces, ["shard_id", "piece_index"], "left")
    cut = ranges.withColumn("data", F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int")))
    whole = cut.groupBy("hash").agg(F.bool_and(F.coalesce(F.length("data") == F.col("length"), F.lit(False))).alias("ok")).where("ok").select("hash")
    found = reassemble(cut.join(whole, "hash", "left_semi"), ["hash"])
    return found, wanted.join(whole, "hash", "left_anti")
