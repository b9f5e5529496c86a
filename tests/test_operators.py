"""Scenarios of the backup system on small tables."""

import datetime as dt
import math
import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage import schemas
from stowage.functions import codecs, paths
from stowage.operators import catalog, chunking, erasure, health, packing, placement, state
from stowage.sources import files as sources
from stowage.sources.blobs import BlobStore

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_schemas_conform(spark):
    for name in schemas.TABLES:
        assert schemas.conform(spark.createDataFrame([(1,)], "id int"), name).schema.fieldNames() == schemas.schema(name).fieldNames()


def test_crawl_exclude_and_restore(spark, tmp_path):
    for name, data in {"a/f1.txt": "DUPLICATE", "a/f2.txt": "DUPLICATE", "a/empty": "", "skip/x": "x", "skipped": "y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(data)
    found = sources.crawl(spark, [f"file://{tmp_path}"], with_content=True)
    excludes = spark.createDataFrame([(f"{tmp_path}/skip",)], "prefix string")
    left = sources.exclude(found, excludes)
    assert [r.filename for r in left.orderBy("filename").collect()] == ["empty", "f1.txt", "f2.txt", "skipped"]
    hashed = left.withColumn("hash", paths.content_hash(F.col("content"))).withColumn("ord", F.col("path"))
    assert chunking.dedup(hashed, "hash", "ord", "size").where("refs = 2").count() == 1
    target = tmp_path / "out"
    done = sources.write_files(left.select(F.col("filename").alias("path"), "content", "mtime", F.lit(0o600).cast("long").alias("mode")), str(target))
    assert sum(r.size for r in done.collect()) == 19
    assert (target / "f1.txt").read_text() == "DUPLICATE" and os.stat(target / "f1.txt").st_mode & 0o777 == 0o600
    assert (target / "empty").read_bytes() == b""
    owned = left.select(F.lit("sub/owned").alias("path"), "content", "mtime", F.lit(0).alias("mode"), F.lit(os.getuid() or 12).alias("uid"), F.lit(os.getgid() or 34).alias("gid")).limit(1)
    sources.write_files(owned, str(target)).collect()
    assert (os.stat(target / "sub/owned").st_uid, os.stat(target / "sub/owned").st_gid) == (os.getuid() or 12, os.getgid() or 34)
    with pytest.raises(Exception, match="leads out of the target"):
        sources.write_files(owned.withColumn("path", F.lit("../../elsewhere")), str(target)).collect()


def test_blob_store(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path / "blobs"))
    blobs = lambda *pairs: spark.createDataFrame(list(pairs), "key string, data binary")
    store.put(blobs(("a", b"first"), ("b", b"other")), 1)
    store.put(blobs(("a", b"second"), ("c", b"")), 2)
    store.delete(spark.createDataFrame([("b",)], "key string"), 3)
    assert rows(store.stat().select("key", "size")) == [("a", 6), ("c", 0)]
    assert rows(store.get(spark.createDataFrame([("a",), ("b",), ("x",)], "key string"))) == [("a", b"second")]
    ranges = spark.createDataFrame([("a", 1, 3), ("a", 4, 9), ("b", 0, 1)], "key string, offset long, length long")
    assert [(r.key, bytes(r.data)) for r in store.get_ranges(ranges).orderBy("offset").collect()] == [("a", b"eco"), ("a", b"nd")]


def test_like_of_odd_patterns(spark):
    cases = [("/A/b_c", "B_C", True), ("/a/bxc", "b_c", True), ("/a/b\\c", "b\\c", True), ("/a/b%", "b%", True), ("/a/É", "é", False), ("/a/xyz", "x%z", True), ("/a/xyz", "y", False)]
    df = spark.createDataFrame(cases, "text string, part string, want boolean")
    assert df.where(paths.ends_with(F.col("text"), F.col("part")) == F.col("want")).count() == len(cases)


def test_erasure_by_stripes(spark):
    rng = random.Random(4)
    parts = [(s, p, o, rng.randbytes(ln)) for s in (1, 2) for p, o, ln in ((0, 0, 70), (0, 70, 31), (2, 5, 60))]
    df = spark.createDataFrame(parts, "shard_id long, piece_index int, offset long, data binary")
    whole, small = (erasure.encode(df, 3, 2, 101, stripe=s) for s in (1 << 20, 16))
    key = lambda d: {(r.shard_id, r.piece_index): (bytes(r.data), r.piece_hash) for r in d.collect()}
    assert key(whole) == key(small) and len(key(whole)) == 10 and all(len(d) == 101 for d, _ in key(whole).values())
    assert small.select("shard_id", "shard_hash").distinct().count() == 2
    back = erasure.reconstruct(small.where("piece_index IN (1, 3, 4) OR shard_id = 2 AND piece_index = 0"), 3, 2, stripe=16)
    assert {(r.shard_id, r.piece_index): bytes(r.data) for r in back.collect()} == {k: key(whole)[k][0] for k in [(1, 0), (1, 2), (2, 2)]}


def test_queue_bundles_frames(spark, tmp_path):
    names = spark.createDataFrame([("/q/shard_1_piece_2", "shard_1_piece_2"), ("/q/shard_9_piece_0", "shard_9_piece_0"), ("/q/shard_1_piece_x", "shard_1_piece_x"), ("/q/a_shard_1_piece_2", "a_shard_1_piece_2")], "path string, filename string")
    entries = sources.queue_entries(names)
    assert rows(entries.select("shard_id", "piece_index")) == [(1, 2), (9, 0)]
    assert rows(sources.queue_orphans(entries, spark.createDataFrame([(1,)], "id long")).select("shard_id")) == [(9,)]
    for version in (1, 3, 2):
        sources.write_bundle(spark.createDataFrame([(version,)], "v long"), str(tmp_path / "b"), version)
    assert rows(sources.read_newest_bundle(spark, str(tmp_path / "b"))) == [(3,)]
    items = [(1, b"h" * 32, b"data", 0), (2, b"k" * 32, b"", 3)]
    data = sources.encode_frames(items)
    assert sources.decode_frames(data) == items
    for cut in (4, 20, len(data) - 43):
        with pytest.raises(ValueError):
            sources.decode_frames(data[:cut])


def test_large_file_has_three_chunks(spark):
    data = bytes((i ^ i >> 8 ^ i >> 16) & 255 for i in range(1 << 16)) * 160
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b""))], "id long, data binary")
    chunks = chunking.chunk(df, ["id"], "data")
    assert rows(chunks.select("id", "sequence", "length")) == [(1, 0, 4 << 20), (1, 1, 4 << 20), (1, 2, 2 << 20)]
    assert bytes(chunking.reassemble(chunks, ["id"]).first().content) == data


def test_validation(spark):
    df = spark.createDataFrame([(b"a", "x"), (b"b", None)], "data binary, hash string").withColumn("hash", F.when(F.col("hash") == "x", F.sha2("data", 256)))
    good, bad = chunking.valid(df, F.col("data"), F.col("hash"))
    assert (good.count(), bad.count()) == (1, 1)
    with pytest.raises(Exception, match="hash"):
        chunking.require_valid(df, F.col("data"), F.col("hash")).collect()


def test_needed_and_download(spark):
    existing = spark.createDataFrame([("a",), (None,)], "hash string")
    batches = spark.createDataFrame([(1, ["a", "b", "c", "b"]), (2, ["a"]), (3, [])], "batch long, hashes array<string>")
    assert rows(chunking.needed_indices(batches, existing)) == [(1, [1, 2, 3]), (2, []), (3, [])]
    locations = spark.createDataFrame([("b", 0, 0, 2, 3, 0), ("b", 0, 1, 0, 2, 1), ("z", 5, 0, 0, 1, 0)], schemas.schema("blob_locations").simpleString().replace("struct<", "").rstrip(">").replace("blob_hash:string,shard_id:bigint,offset:bigint,length:bigint,sequence:bigint,piece_index:int", "blob_hash string, shard_id long, piece_index int, offset long, length long, sequence long"))
    pieces = spark.createDataFrame([(0, 0, b"..abc"), (0, 1, b"de")], "shard_id long, piece_index int, data binary")
    found, missing = chunking.download(spark.createDataFrame([("b",), ("z",), ("q",)], "hash string"), locations, pieces)
    assert [(r.hash, bytes(r.content)) for r in found.collect()] == [("b", b"abcde")]
    assert rows(missing) == [("q",), ("z",)]


def simulate(sizes, piece, pieces):
    """Byte ranges appended one after the other, cut at piece ends."""
    out, address = [], 0
    for key, size in enumerate(sizes):
        sequence = 0
        while size:
            take = min(size, piece - address % piece)
            out.append((key, address // (piece * pieces), address // piece % pieces, address % piece, take, sequence))
            address, size, sequence = address + take, size - take, sequence + 1
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 20), st.integers(1, 4))
def test_packing_equals_simulation(spark, sizes, piece, pieces):
    df = spark.createDataFrame(list(enumerate(sizes)), "hash long, size long").withColumn("ord", F.col("hash"))
    assert rows(packing.pack(df, "ord", piece, pieces)) == sorted(simulate(sizes, piece, pieces))


def test_exactly_full_shard_stays_open(spark):
    df = spark.createDataFrame([(0, 8), (1, 0)], "hash long, size long").withColumn("ord", F.col("hash"))
    assert rows(packing.summarise(packing.pack(df, "ord", 4, 2), 8)) == [(0, 8, 1, False)]
    more = spark.createDataFrame([(0, 8), (1, 1)], "hash long, size long").withColumn("ord", F.col("hash"))
    assert rows(packing.summarise(packing.pack(more, "ord", 4, 2), 8)) == [(0, 8, 1, True), (1, 1, 1, False)]


def test_any_n_pieces_recover(spark):
    import itertools

    data = [(s, i, bytes([s, i, 7]) * (i + 1)) for s in range(2) for i in range(3)]
    coded = erasure.encode(spark.createDataFrame(data, "shard_id long, piece_index int, data binary"), 3, 2, 12).toPandas()
    original = {(r.shard_id, r.piece_index): bytes(r.data) for r in coded.itertuples()}
    for lost in list(itertools.combinations(range(5), 2))[:4]:
        left = spark.createDataFrame(coded[~coded.piece_index.isin(lost)])
        back = erasure.reconstruct(left, 3, 2).collect()
        assert {(r.shard_id, r.piece_index) for r in back} == {(s, i) for s in range(2) for i in lost if i < 3}
        assert all(bytes(r.data) == original[r.shard_id, r.piece_index] for r in back)
    assert erasure.reconstruct(spark.createDataFrame(coded[coded.piece_index > 2]), 3, 2).count() == 0
    wrong = spark.createDataFrame(coded).withColumn("data", F.when(F.col("piece_index") == 0, F.lit(b"bad")).otherwise(F.col("data")))
    assert rows(erasure.reconstruct(wrong, 3, 2).select("shard_id", "piece_index")) == [(0, 0), (1, 0)]
    assert erasure.any_copy(wrong).count() == 2


def test_incremental_versions_and_deletion(spark):
    old = spark.createDataFrame([("f", 1), ("gone", 1), ("older", 5)], "path string, mtime long")
    new = spark.createDataFrame([("f", 2), ("n", 1), ("older", 4)], "path string, mtime long")
    assert rows(catalog.changes(old, new, ["path"])) == [("f", "modified"), ("gone", "deleted"), ("n", "new"), ("older", "same")]
    assert catalog.changes(old, old, ["path"]).where("change <> 'same'").count() == 0
    assert catalog.changes(catalog.reset(old), old, ["path"]).where("change = 'modified'").count() == 3
    assert catalog.append_versions(old, new.where("mtime > 1")).count() == 5


def test_restore_as_of(spark):
    directories = spark.createDataFrame([(1, "/home/u")], "id long, full_path string")
    files = spark.createDataFrame([(1, 1, "f.txt", False), (2, 1, "Empty", True)], "id long, dir_id long, filename string, deleted boolean")
    versions = spark.createDataFrame([(10, 1, 1, 100, 2, "p1", 0o644), (11, 1, 2, 101, 4, "p2", 0o644), (12, 2, 1, 100, 0, "", 0o600)], "id long, file_id long, backup_id long, mtime long, size long, hash_plain string, mode long")
    file_blobs = spark.createDataFrame([(10, "b1", 0), (11, "b2", 1), (11, "b1", 0)], "version_id long, hash_encrypted string, sequence long")
    blobs = spark.createDataFrame([("b1", b"V1"), ("b2", b"V2")], "hash_encrypted string, data binary")
    found = catalog.find_files(directories, files, "F.TXT")
    assert rows(found.select("file_id", "path")) == [(1, "/home/u/f.txt")]
    assert catalog.find_files(directories, files, "HOME/u", "contains", include_deleted=True).count() == 2
    for backup, want in ((1, b"V1"), (None, b"V1V2")):
        out = catalog.restore(found, versions, file_blobs, blobs, "/home", "/r", backup).collect()
        assert [(r.path, bytes(r.content)) for r in out] == [("/r/u/f.txt", want)]
    empty = catalog.find_files(directories, files, "/home/u/Empty", "exact", include_deleted=True)
    assert bytes(catalog.restore(empty, versions, file_blobs, blobs, "/home/u/Empty", "/r").first().content) == b""
    backups = spark.createDataFrame([(1, at(1), "running"), (2, at(2), "running")], "id long, start_time timestamp_ntz, status string")
    assert [r.backup_id for r in catalog.history(versions, backups, 1).collect()] == [2, 1]
    assert rows(catalog.directory_state(directories, files, versions)) == [("/home/u", "f.txt", 101)]


def test_prune_and_close(spark):
    stored = spark.createDataFrame([("a", 1, False), ("b", 1, False), ("s", 1, True), ("a", 2, False)], "hash string, owner long, special boolean")
    gone = catalog.orphans(stored, spark.createDataFrame([("a", 1), (None, 1)], "hash string, owner long"))
    assert rows(gone.select("hash", "owner")) == [("a", 2), ("b", 1)]
    blobs = spark.createDataFrame([("b", 1, None), ("c", 1, None)], "hash string, ref_count int, deleted_at timestamp_ntz")
    assert rows(catalog.prune(blobs, gone.where("hash = 'b'"), now()).select("hash", "ref_count")) == [("b", 0), ("c", 1)]
    backups = schemas.conform(spark.createDataFrame([(1,), (2,)], "id long"), "backups")
    done = spark.createDataFrame([(1, at(3), 5, 4)], "backup_id long, end_time timestamp_ntz, offered long, uploaded long")
    assert rows(catalog.close_backups(backups, done).select("id", "status", "uploaded_files")) == [(1, "completed", 4), (2, None, None)]


def test_garbage_collection(spark):
    blobs = spark.createDataFrame(
        [("live", 10, False, 1, None), ("old", 30, False, 0, at(1)), ("fresh", 5, False, 0, dt.datetime(2024, 1, 31, 23, 30)), ("limbo", 5, False, 0, None), ("special", 5, True, 0, at(30))],
        "hash string, size long, special boolean, ref_count long, deleted_at timestamp_ntz",
    )
    kinds = {r[0]: r[1] for r in blobs.select("hash", health.liveness(F.col("ref_count"), F.col("deleted_at"), F.col("special"), now(), 60, 10000)).collect()}
    assert kinds == {"live": "live", "old": "wasted", "fresh": "live", "limbo": "limbo", "special": "live"}
    locations = packing.pack(blobs.withColumn("ord", F.length("hash") * 10 + F.ascii("hash")), "ord", 10, 2).withColumnRenamed("hash", "blob_hash")
    shards = spark.createDataFrame([(0, "sealed", 20), (1, "sealed", 20), (2, "open", 15)], "id long, status string, size long")
    bad = health.waste(locations, blobs, shards, now(), 60, 10000, 0.5)
    assert [r.ratio for r in bad.collect()] == [1.0, 0.5]
    after, gone = health.repack(locations, blobs, bad, now(), 60, 10000, 10, 2)
    assert rows(gone) == [("old",)]
    sizes = {r.blob_hash: r.n for r in after.groupBy("blob_hash").agg(F.sum("length").alias("n")).collect()}
    assert sizes == {"live": 10, "fresh": 5, "limbo": 5, "special": 5}


def test_repair_replication_completion(spark):
    shards = spark.createDataFrame([(1, "sealed", False), (2, "sealed", True), (3, "open", False)], "id long, status string, mirrored boolean")
    outbound = spark.createDataFrame([(1, 0, 1, "uploaded"), (1, 1, 2, "uploaded"), (1, 1, 3, "uploaded"), (1, 2, 4, "uploaded"), (2, 0, 1, "uploaded"), (2, 0, 2, "uploaded")], "shard_id long, piece_index int, peer_id long, status string")
    peers = spark.createDataFrame([(1, None, "trusted"), (2, at(1), "blocked"), (3, at(30), "trusted"), (4, at(1), "trusted")], "id long, last_seen timestamp_ntz, status string")
    assert rows(health.repair_candidates(shards, outbound, 2, 1).select("id")) == []
    lost = health.mark_lost(outbound, peers, now(), 168)
    assert rows(lost.where("status = 'lost'").select("peer_id")) == [(4,)]
    assert rows(health.repair_candidates(shards, lost, 2, 1).select("id")) == [(1,)]
    assert rows(health.replication(shards, lost, 2, 1).select("id", "replication")) == [(1, "partial"), (2, "full"), (3, "none")]
    assert rows(health.completed_shards(lost, 2)) == [(1,)]


def test_challenges(spark):
    pieces = spark.createDataFrame([(1, 0, 5, "uploaded", bytes(1024))], "shard_id long, piece_index int, peer_id long, status string, data binary")
    drawn = health.sample_challenges(pieces, 8)
    assert 1 <= drawn.count() <= 8 and drawn.where(F.col("offset") + 32 > 1024).count() == 0
    joined = drawn.join(pieces.select("shard_id", "data"), "shard_id")
    assert {r[0] for r in joined.select(health.judge(F.col("expected_data"), F.col("data"), F.col("offset"))).collect()} == {"pass"}
    bad = joined.select(health.judge(F.lit(b"x" * 32), F.col("data"), F.col("offset")), health.judge(F.col("expected_data"), F.lit(None).cast("binary"), F.col("offset")))
    assert tuple(bad.first()) == ("fail", "unavailable")
    assert health.refill(pieces, drawn.limit(2)).first().remaining == 2
    assert health.refill(pieces, drawn.limit(0)).first().remaining == 0
    assert health.pick(drawn, ["offset"], 1).collect() == health.pick(drawn, ["offset"], 1).collect()


def test_peers(spark):
    peers = spark.createDataFrame(
        [(1, "k1", "trusted", "manual", at(31), at(1), 0), (2, "k2", "untrusted", "dht", None, at(1), 100), (3, "k3", "blocked", "dht", at(2), at(31), 100)],
        "id long, public_key string, status string, source string, last_seen timestamp_ntz, first_seen timestamp_ntz, max_storage_size long",
    )
    results = spark.createDataFrame([(1, "pass", at(30)), (1, "fail", at(31)), (1, "pass", at(1)), (3, "unavailable", at(30))], "peer_id long, status string, timestamp timestamp_ntz")
    listed = health.list_peers(peers, results, now()).collect()
    assert [(r.id, r.kind, r.made, r.uptime, r.integrity) for r in listed] == [(1, "active", 2, 100.0, 50.0), (3, "pending", 1, 0.0, 0.0), (2, "pending", 0, 0.0, 0.0)]
    assert rows(health.evict(peers, now()).select("id")) == [(1,), (3,)]
    assert rows(health.due_for_contact(peers, now()).select("id")) == [(1,), (2,), (3,)]
    clients = spark.createDataFrame([(7, "k1", "trusted", 5, 10, None), (8, "k9", "trusted", 5, 10, None)], schemas.schema("clients").simpleString()[7:-1].replace("id:bigint,public_key:string,status:string,max_storage_size:bigint,current_storage_size:bigint,last_seen:timestamp_ntz", "id long, public_key string, status string, current_storage_size long, max_storage_size long, last_seen timestamp_ntz"))
    assert rows(health.list_clients(clients, peers).select("id")) == [(8,)]
    offers = spark.createDataFrame([("k9", 5), ("k9", 6), ("nobody", 1)], "public_key string, incoming long")
    assert rows(health.client_quota(offers, clients)) == [("k9", 5, True), ("k9", 6, False), ("nobody", 1, False)]
    outbound = spark.createDataFrame([(2, "uploaded")], "peer_id long, status string")
    hosted = spark.createDataFrame([(2, 15)], "peer_id long, size long")
    asked = spark.createDataFrame([(1, 999), (2, 5), (2, 6), (3, 1), (9, 1)], "peer_id long, incoming long")
    assert rows(health.peer_quota(asked, peers, outbound, hosted, 10).select("peer_id", "incoming", "accepted")) == [(1, 999, True), (2, 5, True), (2, 6, False), (3, 1, False), (9, 1, False)]
    assert health.peer_quota(asked, peers, outbound, hosted, 10, global_cap=20).where("accepted").count() == 1


def test_adoption_batch(spark):
    peers = spark.createDataFrame([(1, "none", None, True), (2, "testing", at(1), False), (3, "testing", at(1), False), (4, "testing", at(31), False)], "id long, adoption_status string, adoption_start_at timestamp_ntz, adoption_requested boolean").withColumn("status", F.lit("untrusted"))
    tests = spark.createDataFrame([("h2", 2), ("h3", 3), ("h4", 4)], "hash string, peer_id long")
    out = health.adopt(peers, tests, spark.createDataFrame([("h2", 2)], "hash string, peer_id long"), now(), 7 * 1440)
    assert rows(out.select("id", "adoption_status", "status")) == [(1, "testing", "untrusted"), (2, "completed", "trusted"), (3, "failed", "discovered"), (4, "testing", "untrusted")]


def test_outbound_flow(spark):
    peers = spark.createDataFrame([(1, "trusted", "none", 10, 0, 0), (2, "untrusted", "none", 9, 100, 0), (3, "blocked", "none", 11, 0, 0), (4, "untrusted", "testing", 12, 100, 0)], "id long, status string, adoption_status string, last_seen long, max_storage_size long, outbound_storage_size long")
    queue = spark.createDataFrame([(1, 1, 0, 60, False), (2, 1, 1, 60, False), (3, 2, 0, 60, False), (4, 1, 2, 60, False)], "ord long, shard_id long, piece_index int, size long, mirrored boolean")
    none = spark.createDataFrame([], "shard_id long, peer_id long, status string")
    assert rows(placement.place(queue, peers, none)) == [(1, 0, 1, 60), (1, 1, 2, 60), (2, 0, 1, 60)]
    held = spark.createDataFrame([(1, 1, "lost"), (1, 1, "uploaded"), (1, 2, "uploaded")], "shard_id long, peer_id long, status string")
    offered = peers.withColumn("shard_id", F.lit(1).cast("long"))
    assert rows(placement.lacking(offered, held).select("id")) == [(1,), (3,), (4,)]
    assert placement.jobs_per_peer(placement.place(queue, peers, none)).where("peer_id = 1").first().bytes == 120
    assert placement.place(queue, peers, none, parts=2).count() <= 3


def placed_one_by_one(queue, peers, held):
    """The definition: each piece of the whole queue, in order, looks at all peers in order."""
    peers = sorted(peers, key=lambda p: (math.inf if p[3] is None or math.isnan(p[3]) else -p[3], p[0]))
    used, holds, out = {p[0]: p[5] for p in peers}, {(shard, peer) for shard, peer, status in held if status in ("pending", "uploaded")}, []
    for _, shard, piece, size, mirrored in sorted(queue, key=lambda q: (q[0] is None, q[0] or 0, -1 if q[1] is None else q[1], q[2])):
        for id_, status, adoption, _, most, _ in peers:
            fits = size is not None and most is not None and used[id_] + size <= most
            fine = status != "blocked" and (mirrored or (status == "untrusted" and adoption == "none" and fits) or (status == "trusted" and (most == 0 or fits)))
            if fine and (shard, id_) not in holds:
                if shard is not None:
                    holds.add((shard, id_))
                used[id_] += size or 0
                out.append((shard, piece, id_, size))
                break
    return sorted(out, key=str)


PEERS = "id long, status string, adoption_status string, last_seen double, max_storage_size long, outbound_storage_size long"
QUEUE = "ord long, shard_id long, piece_index int, size long, mirrored boolean"


@pytest.fixture
def few_rows_a_batch(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, 7)
    yield
    spark.conf.set(conf, before)


@pytest.mark.parametrize("seed", range(3))
def test_placement_over_many_runs(spark, few_rows_a_batch, seed):
    rng = random.Random(seed)
    free = 0 if seed == 2 else None  # a peer without quota takes all that is left
    peers = [(i, rng.choice(["trusted", "trusted", "untrusted", "blocked", None]), rng.choice(["none", "none", "testing"]), rng.choice([None, math.nan, 1.0, 2.0, -3.0]), rng.choice([None, 50, 90, 400]), rng.choice([0, 0, 30, 95])) for i in range(600)]
    peers.append((600, "trusted", "none", -9.0, free, 0))
    shards = [s for s in [*range(90), None] for _ in range(rng.randrange(1, 14))]
    if seed:  # shards one within the other
        rng.shuffle(shards)
    queue = [(rng.choice([None, k // 2, k // 2, k // 2]), shard, k, rng.choice([None, 0, -4, 1, 2, 7, 30, 31, 32, 33, 64]), rng.random() < 0.1) for k, shard in enumerate(shards)]
    held = [(rng.randrange(90), rng.randrange(60), rng.choice(["pending", "uploaded", "lost"])) for _ in range(300)]
    out = placement.place(spark.createDataFrame(queue, QUEUE), spark.createDataFrame(peers, PEERS), spark.createDataFrame(held, "shard_id long, peer_id long, status string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == placed_one_by_one(queue, peers, held)


def test_placement_in_parts(spark, few_rows_a_batch):
    peers = [(i, "trusted", "none", float(i), 40, 0) for i in range(30)]
    queue = [(k, k // 4, k % 4, 5, False) for k in range(120)]
    none = spark.createDataFrame([], "shard_id long, peer_id long, status string")
    out = placement.place(spark.createDataFrame(queue, QUEUE), spark.createDataFrame(peers, PEERS), none, parts=3)
    part = spark.createDataFrame(queue, QUEUE).select("shard_id", F.pmod(F.xxhash64("shard_id"), F.lit(3)).alias("part")).distinct()
    want = []
    for p in range(3):  # a third of 40, in whole bytes
        mine = {r.shard_id for r in part.where(F.col("part") == p).collect()}
        want += placed_one_by_one([q for q in queue if q[1] in mine], [(*x[:4], 13, 0) for x in peers], [])
    assert rows(out) == sorted(want)


def test_placement_holds_no_queue(spark):
    """No task takes the queue, or a part of it, as one group; shards that are done are forgotten."""
    peers, queue = spark.createDataFrame([(1, "trusted", "none", 1.0, 0, 0)], PEERS), spark.createDataFrame([(1, 1, 0, 5, False)], QUEUE)
    plan = placement.place(queue, peers, spark.createDataFrame([], "shard_id long, peer_id long, status string"))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "MapInArrow" in plan
    choice = placement.Choice(1)
    choice.offer(pa.RecordBatch.from_pylist([{"id": i, "most": 10**6, "used": 0, "active": True, "bounded": True, "free": False} for i in range(300)]))
    for run in range(50):
        out = choice.assign(pa.RecordBatch.from_pylist([{"shard_id": run * 25 + k // 4, "piece_index": k % 4, "size": 3, "mirrored": False, "first": k % 4 == 0, "last": k % 4 == 3, "held": []} for k in range(100)]))
        assert out.num_rows == 100 and not choice.holders


def test_two_owners_and_twice_offered(spark):
    log = spark.createDataFrame([("h", "A", 1, 1), ("h", "B", 1, 2), ("h", "A", 1, 3), ("h", "A", -1, 4), ("h", "B", -1, 5)], "hash string, peer_id string, delta long, seq long")
    owners = state.release_references(log, ["seq"])
    assert rows(owners) == [("h", "A", 1)]
    assert state.unowned(log, owners).count() == 0
    gone = log.union(spark.createDataFrame([("h", "A", -1, 6)], log.schema))
    assert rows(state.unowned(gone, state.release_references(gone, ["seq"]))) == [("h",)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=20))
def test_clamped_total(spark, deltas):
    df = spark.createDataFrame(list(enumerate(deltas)), "seq long, delta long").withColumn("k", F.lit(1))
    want = 0
    for d in deltas:
        want = max(0, want + d)
    assert state.clamped_total(df, ["k"], ["seq"], "delta", "n").first().n == want
    assert df.groupBy().agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("a")).select(state.clamped_fold(F.transform("a", lambda x: x["delta"])).alias("n")).first().n == want


def test_small_functions(spark):
    df = spark.createDataFrame([("/a/b.txt", 0), ("/top", 3 << 30)], "path string, size long")
    assert rows(df.select(paths.dir_name(F.col("path")), paths.base_name(F.col("path")), paths.format_bytes(F.col("size")))) == [("/", "top", "3.00 GB"), ("/a", "b.txt", "0 B")]
    one = df.limit(1).select(paths.short_hash(F.lit("")), paths.short_hash(F.lit("x" * 40)), paths.sealed_hash(F.lit("p"), "k") == paths.sealed_hash(F.lit("p"), "k"), paths.percentage(F.lit(1), F.lit(0)), paths.relative_path(F.lit("/a/b"), F.lit("/a")))
    assert tuple(one.first()) == ("(empty file)", "x" * 32 + "...", True, 0.0, "b")
    assert len(df.select(codecs.test_bytes(F.lit(1), 100)).first()[0]) == 100
    kinds = spark.createDataFrame([(b"abc", "none")], "data binary, codec string")
    assert bytes(kinds.select(codecs.decompress(F.col("data"), F.col("codec"))).first()[0]) == b"abc"
    swapped = state.compare_and_swap(spark.createDataFrame([(1, "none"), (2, "testing")], "id long, s string"), "s", "none", "testing", F.lit(True))
    assert rows(swapped) == [(1, "testing", True), (2, "testing", False)]
