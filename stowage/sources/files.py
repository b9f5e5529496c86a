"""Sources and sinks: directory scans, file contents, queue folders, versioned bundles, frames."""

from __future__ import annotations

import contextlib
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, dir_name, local_path


def crawl(spark: SparkSession, roots: list[str], with_content: bool = False) -> DataFrame:
    """(path, dir_path, filename, mtime, size[, content]) of every file under the roots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    files = files.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if with_content else []))
    empty = empty_files(spark, roots)
    if with_content:
        empty = empty.withColumn("content", F.lit(b""))
    path = local_path(F.col("path"))
    return files.unionByName(empty).select(path.alias("path"), dir_name(path).alias("dir_path"), base_name(path).alias("filename"), "mtime", "size", *(["content"] if with_content else []))


def empty_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, mtime, size) of files without bytes, which file scans leave out. Listed like a scan's files, on the driver."""
    found = []
    for root in roots:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        listing = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while listing.hasNext():
            status = listing.next()
            if status.getLen() == 0:
                found.append((status.getPath().toString(), status.getModificationTime() // 1000, 0))
    return spark.createDataFrame(found, "path string, mtime long, size long")


def exclude(files: DataFrame, excludes: DataFrame) -> DataFrame:
    """Files whose path is no excluded path (column prefix) and lies under none.

    A path's ancestors are joined by equality, so the exclusions may be many.
    """
    parts = F.split(F.col("path"), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hit = files.select("path", F.explode(ancestors).alias("prefix")).join(excludes.select("prefix").distinct(), "prefix", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def queue_entries(files: DataFrame) -> DataFrame:
    """(path, shard_id, piece_index) of files named ``shard_<id>_piece_<n>``; other names are skipped."""
    pattern = r"^shard_(\d+)_piece_(\d+)$"
    named = files.where(F.col("filename").rlike(pattern))
    return named.select("path", F.regexp_extract("filename", pattern, 1).cast("long").alias("shard_id"), F.regexp_extract("filename", pattern, 2).cast("int").alias("piece_index"))


def queue_orphans(entries: DataFrame, shards: DataFrame) -> DataFrame:
    """Queue entries of shards that are gone."""
    return entries.join(shards.select(F.col("id").alias("shard_id")), "shard_id", "left_anti")


def write_bundle(df: DataFrame, folder: str, version: int) -> None:
    """One consistent snapshot as ``folder/version=N``."""
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_newest_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the highest version, which only that partition is read for."""
    versions = spark.read.parquet(folder)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == F.lit(newest)).drop("version")


def write_files(restored: DataFrame, target: str) -> DataFrame:
    """Write (path, content, mtime, mode[, uid, gid]) under ``target``, a folder all executors share; returns (path, size).

    Modes, owners and times of 0 or null aren't set; owners are where the process may. A path that leads out of
    ``target`` fails the query. Rows are written where they are, so a retry writes the same file again.
    """
    root = os.path.realpath(target)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = []
            for row in frame.itertuples(index=False):
                path = os.path.realpath(os.path.join(root, row.path.lstrip("/")))
                if os.path.commonpath((root, path)) != root:
                    raise ValueError(f"path leads out of the target: {row.path}")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                content = row.content or b""
                with open(path, "wb") as out:
                    out.write(content)
                if pd.notna(row.mode) and row.mode:
                    os.chmod(path, int(row.mode) & 0o7777)
                uid, gid = (0 if pd.isna(x) else int(x) for x in (row.uid, row.gid))
                if uid or gid:
                    with contextlib.suppress(PermissionError):
                        os.chown(path, uid, gid)
                if pd.notna(row.mtime) and row.mtime:
                    os.utime(path, (int(row.mtime), int(row.mtime)))
                sizes.append(len(content))
            yield pd.DataFrame({"path": frame["path"], "size": sizes})

    owners = [F.col(c) if c in restored.columns else F.lit(None).cast("long").alias(c) for c in ("uid", "gid")]
    return restored.select("path", "content", "mtime", "mode", *owners).mapInPandas(put, "path string, size long")


#: Big-endian item header: operation, 32-byte hash, size, flags.
ITEM = struct.Struct(">B32sQB")
BATCH = struct.Struct(">Q")


def encode_frames(items: list[tuple[int, bytes, bytes, int]]) -> bytes:
    """A batch of (operation, hash, data, flags) as one byte string."""
    return BATCH.pack(len(items)) + b"".join(ITEM.pack(op, key, len(data), flags) + data for op, key, data, flags in items)


def decode_frames(data: bytes) -> list[tuple[int, bytes, bytes, int]]:
    """The items of a batch; a short one raises ``ValueError``."""
    if len(data) < BATCH.size:
        raise ValueError("short batch header")
    (count,), at, items = BATCH.unpack_from(data), BATCH.size, []
    for _ in range(count):
        if at + ITEM.size > len(data):
            raise ValueError("short item header")
        op, key, size, flags = ITEM.unpack_from(data, at)
        at += ITEM.size
        if at + size > len(data):
            raise ValueError("short item")
        items.append((op, key, data[at : at + size], flags))
        at += size
    return items
