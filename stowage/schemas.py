"""Schemas of the client's and the server's catalog tables.

Hashes are lowercase hexadecimal strings, sizes and identifiers are longs,
flags are booleans, times are timestamps without a zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

CLIENT = {
    "backups": "id long, start_time timestamp_ntz, end_time timestamp_ntz, status string, offered_files long, uploaded_files long",
    "directory_backups": "id long, backup_id long, dir_id long, completed_at timestamp_ntz",
    "directories": "id long, full_path string, first_seen timestamp_ntz, last_seen timestamp_ntz",
    "files": "id long, dir_id long, filename string, first_seen timestamp_ntz, last_seen timestamp_ntz, deleted boolean",
    "file_versions": "id long, file_id long, backup_id long, mtime long, size long, hash_plain string, uid long, gid long, mode long, created_at timestamp_ntz",
    "local_blobs": "hash_plain string, hash_encrypted string, size long",
    "file_blobs": "version_id long, hash_encrypted string, size long, sequence long",
}
SERVER = {
    "shards": "id long, status string, size long, mirrored boolean, hash string, sequence long, total_pieces long, created_at timestamp_ntz",
    "blobs": "hash string, size long, special boolean, ref_count long, created_at timestamp_ntz, deleted_at timestamp_ntz",
    "blob_locations": "blob_hash string, shard_id long, offset long, length long, sequence long, piece_index int",
    "peers": "id long, ip_address string, public_key string, status string, first_seen timestamp_ntz, last_seen timestamp_ntz, max_storage_size long, current_storage_size long, outbound_storage_size long, contact_info string, total_shards long, current_shards long, is_manual boolean, source string, inbound_bytes long, outbound_bytes long, adoption_status string, adoption_start_at timestamp_ntz",
    "clients": "id long, public_key string, status string, max_storage_size long, current_storage_size long, last_seen timestamp_ntz",
    "hosted_shards": "hash string, size long, peer_id long, is_special boolean, piece_index int, parent_shard_hash string, sequence long, total_pieces long, created_at timestamp_ntz, ref_count long",
    "adoption_tests": "hash string, size long, peer_id long, created_at timestamp_ntz",
    "outbound_pieces": "shard_id long, piece_index int, peer_id long, status string, created_at timestamp_ntz",
    "piece_challenges": "id long, shard_id long, piece_index int, peer_id long, piece_hash string, offset long, expected_data binary",
    "challenge_results": "id long, peer_id long, shard_id long, piece_index int, status string, timestamp timestamp_ntz",
}
TABLES = CLIENT | SERVER

PEER_STATUSES = ("discovered", "untrusted", "trusted", "blocked")
ADOPTION_STATUSES = ("none", "testing", "completed", "failed")
CHALLENGE_RESULTS = ("ok", "pass", "fail", "unavailable")


def schema(table: str) -> T.StructType:
    """The schema of a catalog table."""
    return T._parse_datatype_string(TABLES[table])


def conform(df, table: str):
    """``df`` with exactly the table's columns: missing ones null, the others cast (additive evolution)."""
    from pyspark.sql import functions as F

    fields = schema(table).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
