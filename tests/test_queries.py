import pytest

from stowage.plans.registry import ORACLES, QUERIES

from .conftest import SF
from .oracle import connect, same_rows


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SF), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_placement_equals_simulation(spark):
    rows = QUERIES["placement_greedy"](spark, SF).collect()
    lines = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect():
        lines[r[0], r[1]] = max(lines.get((r[0], r[1]), 0), int(r[2]))
    peers = sorted(((r.s_suppkey, r.s_acctbal) for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()), key=lambda p: (-p[1], p[0]))
    used, holds, want = {p: 0 for p, _ in peers}, set(), []
    for (shard, piece), size in sorted(lines.items(), key=lambda x: x[0][0] * 10 + x[0][1]):
        for peer, _ in peers:
            if used[peer] + size <= 20_000 and (shard, peer) not in holds:
                used[peer] += size
                holds.add((shard, peer))
                want.append((shard, piece, peer, size))
                break
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_recovered_and_compressed(spark):
    rows = QUERIES["erasure_recovery"](spark, SF).collect()
    assert rows and all(r.recovered for r in rows)
    assert all(r.same for r in QUERIES["compressed_roundtrip"](spark, SF).collect())


def test_erasure_recovery_covers_whole_texts(spark):
    from stowage.plans import registry

    texts = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect():
        texts[r.text] = min(r.doc_id, texts.get(r.text, r.doc_id))
    stream = b"".join(text.encode() for text in sorted(texts, key=texts.get))
    piece = registry.SHARD_BYTES // registry.SHARD_PIECES
    parts = registry.parts_of_pieces(spark, SF).collect()
    assert sum(len(r.data) for r in parts) == len(stream)
    for r in parts:
        start = r.shard_id * registry.SHARD_BYTES + r.piece_index * piece + r.offset
        assert stream[start : start + len(r.data)] == bytes(r.data)
    shards = -(-len(stream) // registry.SHARD_BYTES)
    assert {r.shard_id for r in QUERIES["erasure_recovery"](spark, SF).collect()} == set(range(shards))
