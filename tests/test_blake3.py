"""BLAKE3 against published hashes and a plain recursive version of the specification."""

import numpy as np
import pytest

from stowage.functions.blake3 import CHUNK, CHUNK_END, CHUNK_START, IV, PARENT, PERMUTATION, ROOT, blake3, digests
from stowage.operators import chunking

from .conftest import SF

MASK = 0xFFFFFFFF
# published hashes: of "abc", and of the bytes 0, 1, ... 250, 0, ... of a length
ABC = "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
KNOWN = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
}


def counted(n: int) -> bytes:
    return bytes(i % 251 for i in range(n))


def plain_compress(chain, block, counter, length, flags):
    v = [*chain, *map(int, IV[:4]), counter & MASK, counter >> 32, length, flags]
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]

    def turn(x, n):
        return (x >> n | x << (32 - n)) & MASK

    for _ in range(7):
        for i, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            for word, one, two in ((m[2 * i], 16, 12), (m[2 * i + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & MASK
                v[d] = turn(v[d] ^ v[a], one)
                v[c] = (v[c] + v[d]) & MASK
                v[b] = turn(v[b] ^ v[c], two)
        m = [m[p] for p in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def plain_node(data: bytes, first: int, root: bool):
    if len(data) <= CHUNK:
        chain, blocks = [int(x) for x in IV], [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
        for i, block in enumerate(blocks):
            flags = (CHUNK_START if i == 0 else 0) | ((CHUNK_END | (ROOT if root else 0)) if i == len(blocks) - 1 else 0)
            chain = plain_compress(chain, block.ljust(64, b"\0"), first, len(block), flags)
        return chain
    chunks = -(-len(data) // CHUNK)
    left = 1 << ((chunks - 1).bit_length() - 1)
    words = plain_node(data[: left * CHUNK], first, False) + plain_node(data[left * CHUNK :], first + left, False)
    return plain_compress([int(x) for x in IV], b"".join(w.to_bytes(4, "little") for w in words), 0, 64, PARENT | (ROOT if root else 0))


def plain(data: bytes) -> str:
    return b"".join(w.to_bytes(4, "little") for w in plain_node(data, 0, True)).hex()


def hashes(values: list[bytes]) -> list[str]:
    return [row.tobytes().hex() for row in digests([np.frombuffer(v, np.uint8) for v in values])]


def test_published_hashes():
    assert plain(b"abc") == ABC and hashes([b"abc"]) == [ABC]
    assert dict(zip(KNOWN, hashes([counted(n) for n in KNOWN]))) == KNOWN


@pytest.mark.parametrize("lanes", [1, 3, 4096])
def test_many_values_at_once(monkeypatch, lanes):
    monkeypatch.setattr("stowage.functions.blake3.LANES", lanes)
    values = [counted(n) for n in (0, 63, 64, 65, 1023, 3 * 1024, 3 * 1024 + 1, 5000, 0, 7 * 1024, 9 * 1024 - 1, 16 * 1024, 17 * 1024 + 5)]
    assert hashes(values) == [plain(v) for v in values]
    assert hashes([]) == []


def test_large_value(monkeypatch):
    """More chunks than are compressed at once: how they are dealt out changes nothing."""
    value = counted(6 << 20)
    whole = hashes([value, b"abc"])
    assert whole[1] == ABC
    monkeypatch.setattr("stowage.functions.blake3.LANES", 1000)
    assert hashes([value, b"abc"]) == whole


def test_columns(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "é" * 2000)], "id int, text string")
    got = {r.id: r.hash for r in rows.select("id", blake3(rows["text"]).alias("hash")).collect()}
    assert got == {1: ABC, 2: None, 3: KNOWN[0], 4: plain(("é" * 2000).encode())}
    named = chunking.manifest(chunking.chunk(rows, ["id"], "text", 2), ["id"], hash_of=blake3)
    assert {(r.sequence, r.hash) for r in named.where("id = 1").collect()} == {(0, plain(b"ab")), (1, plain(b"c"))}
    good, bad = chunking.valid(rows.select("id", "text", blake3(rows["text"]).alias("claimed")), rows["text"], blake3(rows["text"]), hash_of=blake3)
    assert sorted(r.id for r in good.collect()) == [1, 3, 4] and [r.id for r in bad.collect()] == [2]


def test_manifest_query(spark):
    from stowage.plans.registry import CHUNK_CHARS, QUERIES

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    cuts = [(i, at // CHUNK_CHARS, t[at : at + CHUNK_CHARS]) for i, t in texts if t for at in range(0, len(t), CHUNK_CHARS)]
    want = sorted((i, n, plain(cut.encode()), len(cut)) for i, n, cut in cuts)
    assert sorted((r.doc_id, r.sequence, r.hash, r.length) for r in QUERIES["chunk_manifest_blake3"](spark, SF).collect()) == want
