"""Packing blobs into shards of N pieces.

Blobs are laid end to end in their order; a byte's shard and piece follow from
its address, so packing is a running sum of sizes and a cut at piece borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def addresses(blobs: DataFrame, order: str, size: str = "size", parts: int | None = None) -> DataFrame:
    """Adds start, the sum of the sizes before each row by ``order`` (unique, ascending).

    Rows are grouped into ranges of the order column by quantiles; running
    sums within a range need only its rows, and the ranges' totals (one row
    each) are summed over all. No window covers the whole table.
    """
    parts = parts or int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a subquery of the same plan, which so computes the blobs once
    bounds = blobs.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).scalar()
    dealt = blobs.withColumn("_bounds", bounds).withColumn("_range", F.size(F.filter("_bounds", lambda bound: F.col(order) > bound))).drop("_bounds")
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return summed.join(F.broadcast(offsets), "_range").withColumn("start", F.col("_offset") + F.col("_within")).drop("_range", "_within", "_offset")


def pack(blobs: DataFrame, order: str, piece_size: int, pieces: int, key: str = "hash", size: str = "size") -> DataFrame:
    """Locations: key, shard_id, piece_index, offset (in the piece), length, sequence (in the blob).

    A blob is split at the borders of pieces, hence of shards; one of size 0 has no location.
    """
    placed = addresses(blobs, order, size).where(F.col(size) > 0)
    end = F.col("start") + F.col(size)
    cut = placed.select(key, "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / piece_size), F.floor((end - 1) / piece_size))).alias("slot"))
    begin = F.greatest(F.col("start"), F.col("slot") * piece_size)
    return cut.select(
        key,
        F.floor(F.col("slot") / pieces).cast("long").alias("shard_id"),
        (F.col("slot") % pieces).cast("int").alias("piece_index"),
        (begin - F.col("slot") * piece_size).cast("long").alias("offset"),
        (F.least(F.col("end"), (F.col("slot") + 1) * piece_size) - begin).cast("long").alias("length"),
        (F.col("slot") - F.floor(F.col("start") / piece_size)).cast("int").alias("sequence"),
    )


def summarise(locations: DataFrame, shard_size: int, key: str = "hash") -> DataFrame:
    """Per shard: bytes, blobs and whether it is sealed, that is full with a later byte beyond it."""
    last = locations.agg(F.max("shard_id")).scalar()
    return locations.groupBy("shard_id").agg(F.sum("length").alias("bytes"), F.countDistinct(key).alias("blobs")).withColumn("sealed", (F.col("bytes") == shard_size) & (F.col("shard_id") < last))
