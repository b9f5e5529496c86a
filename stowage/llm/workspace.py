"""Intermediate tables in the folder that all executors share.

``keep`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and reads
it back: lineage ends there, and a lost executor costs no recomputation.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Spark's setting that removes the shuffle files of a query when it ends, not when the driver's garbage is collected.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in a local session without one, a folder of our own."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "stowage-checkpoints")
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, unless the caller has set another number.

    Spark bounds them by bytes as well (64 MB by default), so that Python workers hold few whole texts at once.
    """
    if int(spark.conf.get(BATCH_CONF)) in (0, 10_000):  # unbounded, or Spark's own default
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files on the executors' disks; the caller's setting comes back after."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` into the application's part of the shared folder, which goes with it; returns the table read back and its path.

    Nothing needs the shuffles of the write once its table is there, so they go at once.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/stowage/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    _file_system(spark, folder).deleteOnExit(_path(spark, folder))
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``keep`` that nothing reads any more."""
    _file_system(spark, path).delete(_path(spark, path), True)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: A group of more than this part of all rows is dealt to several tasks.
HOT = 256


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], how: str) -> DataFrame:
    """Joins each of ``rows`` with its group; a hot group's rows go to many tasks, by a hash of ``spread``.

    ``groups`` is a written table with one row per key and n, the number of ``rows`` it has. Fewer than HOT
    groups can have more than a HOT-th of all, so these are broadcast at any size of input.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") * HOT > total).select(*keys, F.ceil(F.col("n") * HOT / max(total, 1)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    spreads = groups.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts", "n")
    return dealt.join(spreads, [*keys, "_part"], how).drop("_part")
