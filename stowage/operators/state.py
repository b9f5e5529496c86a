"""Current state folded from an immutable log of changes.

Every mutation is a row with an order column; upserts, counters and
reference counts are folds of the log, so no table is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (insert or update)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(*keys, "_s.*")


def first_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (insert or ignore)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(*keys, "_s.*")


def running_total(log: DataFrame, keys: list[str], delta: str, name: str) -> DataFrame:
    """Counters kept by additions and subtractions: their sum."""
    return log.groupBy(*keys).agg(F.coalesce(F.sum(delta), F.lit(0)).alias(name))


def clamped_fold(deltas: Column) -> Column:
    """The counter after deltas in order, never below zero after any of them."""
    return F.aggregate(deltas, F.lit(0).cast("long"), lambda n, d: F.greatest(n + d, F.lit(0).cast("long")))


def clamped_total(log: DataFrame, keys: list[str], order: list[str], delta: str, name: str) -> DataFrame:
    """Counters with subtraction clamped at zero, which depends on the order.

    In closed form: with running sums s, the counter ends at s_last - min(0, min s).
    Running sums come from a window; nothing collects a key's log.
    """
    from pyspark.sql import Window

    running = F.sum(delta).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("_run", running).groupBy(*keys).agg((F.coalesce(F.sum(delta), F.lit(0)) - F.least(F.lit(0), F.min("_run"))).alias(name))


def compare_and_swap(rows: DataFrame, column: str, expected: str, new: str, only: Column) -> DataFrame:
    """Rows with ``column`` set to ``new`` where it was ``expected`` and ``only`` holds, and whether it was."""
    hit = F.coalesce((F.col(column) == expected) & only, F.lit(False))
    return rows.withColumn("swapped", hit).withColumn(column, F.when(F.col("swapped"), F.lit(new)).otherwise(F.col(column)))


def release_references(log: DataFrame, order: list[str]) -> DataFrame:
    """Owners (hash, peer_id, ref_count > 0) after all offers (+1) and releases (-1), clamped at zero."""
    return clamped_total(log, ["hash", "peer_id"], order, "delta", "ref_count").where("ref_count > 0")


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that stand in both tables."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def unowned(hashes: DataFrame, owners: DataFrame) -> DataFrame:
    """Hashes whose bytes may be deleted: no owner is left."""
    return hashes.select("hash").distinct().join(owners.select("hash"), "hash", "left_anti")
