"""The client's catalog: snapshots, changes, versions, history, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name, contains, dir_name, ends_with, restore_path
from .chunking import reassemble
from .state import latest_wins


def directory_state(directories: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """(dir_path, filename, mtime): the last version (highest id) of every file that isn't deleted."""
    last = versions.groupBy("file_id").agg(F.max_by("mtime", "id").alias("mtime"))
    live = files.where(~F.col("deleted")).select(F.col("id").alias("file_id"), "dir_id", "filename")
    named = live.join(directories.select(F.col("id").alias("dir_id"), F.col("full_path").alias("dir_path")), "dir_id")
    return named.join(last, "file_id").select("dir_path", "filename", "mtime")


def changes(old: DataFrame, new: DataFrame, keys: list[str], mtime: str = "mtime") -> DataFrame:
    """Keys and change: new, modified (strictly newer), deleted or same, from two snapshots."""
    a = old.select(*keys, F.col(mtime).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(mtime).alias("_new"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_new") > F.col("_old"), "modified").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change"))


def append_versions(versions: DataFrame, changed: DataFrame) -> DataFrame:
    """The version log with the changed files' new versions; columns missing there are null."""
    return versions.unionByName(changed.select(*[c for c in versions.columns if c in changed.columns]), allowMissingColumns=True)


def reset(snapshot: DataFrame) -> DataFrame:
    """A snapshot in which every file looks older than anything on disk, so that all are scanned again."""
    return snapshot.withColumn("mtime", F.lit(0).cast("long"))


def version_as_of(versions: DataFrame, key: str, order: list[str], condition: Column | None = None) -> DataFrame:
    """The last version of each key among those that meet the condition (all by default)."""
    seen = versions if condition is None else versions.where(condition)
    return latest_wins(seen, [key], order)


def history(versions: DataFrame, backups: DataFrame, file_id: int | None = None) -> DataFrame:
    """Versions with their backups' start and status, newest first; of one file or all."""
    some = versions if file_id is None else versions.where(F.col("file_id") == file_id)
    start = backups.select(F.col("id").alias("backup_id"), "start_time", "status")
    joined = some.join(start, "backup_id").select("file_id", F.col("id").alias("version_id"), "backup_id", "start_time", "status", "mtime", "size", "hash_plain")
    return joined.orderBy("file_id", F.desc("backup_id"), F.desc("version_id"))


def find_files(directories: DataFrame, files: DataFrame, text: str, how: str = "suffix", include_deleted: bool = False) -> DataFrame:
    """(file_id, path, deleted) whose path equals, ends with, or contains a text, regardless of case.

    ``include_deleted`` is for restores from an older backup.
    """
    joined = files.select(F.col("id").alias("file_id"), "dir_id", "filename", "deleted").join(directories.select(F.col("id").alias("dir_id"), "full_path"), "dir_id")
    path = F.concat(F.regexp_replace("full_path", "/+$", ""), F.lit("/"), F.col("filename"))
    match = {"exact": path == text, "suffix": ends_with(path, F.lit(text)), "contains": contains(path, F.lit(text))}[how]
    kept = joined if include_deleted else joined.where(~F.col("deleted"))
    return kept.where(match).select("file_id", path.alias("path"), "deleted")


def restore(found: DataFrame, versions: DataFrame, file_blobs: DataFrame, blobs: DataFrame, requested: str, target: str, backup_id: int | None = None) -> DataFrame:
    """(path, content, mtime, uid, gid, mode) of files found, as of a backup.

    ``blobs`` has hash_encrypted and data. Empty files have no blobs and empty
    content; files with a missing blob give no row.
    """
    seen = versions.join(found.select("file_id"), "file_id", "left_semi")
    last = version_as_of(seen, "file_id", ["id"], None if backup_id is None else F.col("backup_id") <= backup_id)
    chosen = last.join(found.select("file_id", "path"), "file_id")
    parts = chosen.select(F.col("id").alias("version_id")).join(file_blobs, "version_id").join(blobs.select("hash_encrypted", "data"), "hash_encrypted", "left")
    broken = parts.where(F.col("data").isNull()).select("version_id").distinct()
    content = reassemble(parts.select("version_id", "sequence", "data"), ["version_id"])
    out = chosen.withColumn("version_id", F.col("id")).join(broken, "version_id", "left_anti").join(content, "version_id", "left")
    goes = restore_path(F.col("path"), F.lit(requested), F.lit(target))
    owners = [F.col(c) if c in versions.columns else F.lit(None).cast("long").alias(c) for c in ("uid", "gid")]
    return out.select(goes.alias("path"), F.coalesce("content", F.lit(b"")).alias("content"), "mtime", *owners, "mode")


def lookup(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows whose key columns equal one of ``keys``: point lookups of many keys in one join."""
    return rows.join(keys.select(*columns).distinct(), list(columns), "left_semi")


def by_public_key(rows: DataFrame, peers: DataFrame) -> DataFrame:
    """Rows that name a peer by public_key, with its peer_id; unknown keys go."""
    return rows.join(peers.select(F.col("id").alias("peer_id"), "public_key"), "public_key").drop("public_key")


def split_path(rows: DataFrame, path: str) -> DataFrame:
    """Adds dir_path and filename."""
    return rows.withColumn("dir_path", dir_name(F.col(path))).withColumn("filename", base_name(F.col(path)))


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored rows (hash, owner, special) no manifest of their owner refers to; special ones are never orphans."""
    return stored.where(~F.col("special")).join(referenced.select("hash", "owner").distinct(), ["hash", "owner"], "left_anti")


def prune(blobs: DataFrame, orphan_hashes: DataFrame, at: Column) -> DataFrame:
    """Blobs with orphans softly deleted: no references, deleted_at set unless it was."""
    marked = blobs.join(orphan_hashes.select("hash", F.lit(True).alias("_gone")).distinct(), "hash", "left")
    gone = F.coalesce("_gone", F.lit(False))
    return marked.withColumn("ref_count", F.when(gone, F.lit(0)).otherwise(F.col("ref_count"))).withColumn("deleted_at", F.when(gone, F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at"))).drop("_gone")


def close_backups(backups: DataFrame, completed: DataFrame) -> DataFrame:
    """Backups (id, …) with end_time, status and file counts from ``completed`` (backup_id, end_time, offered, uploaded)."""
    done = completed.select(F.col("backup_id").alias("id"), F.col("end_time").alias("_end"), "offered", "uploaded")
    joined = backups.join(done, "id", "left")
    return joined.select(
        *[c for c in backups.columns if c not in ("end_time", "status", "offered_files", "uploaded_files")],
        F.coalesce("_end", "end_time").alias("end_time"),
        F.when(F.col("_end").isNotNull(), F.lit("completed")).otherwise(F.col("status")).alias("status"),
        F.coalesce("offered", "offered_files").alias("offered_files"),
        F.coalesce("uploaded", "uploaded_files").alias("uploaded_files"),
    )
