"""Convergent encryption against published vectors, and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.functions.blake3 import blake3
from stowage.functions.sealing import LANES, NONCE, TAG, decrypt, encrypt, open_sealed, seal, subkeys

from .conftest import SF

KEY = bytes(range(0x80, 0xA0))


def array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def test_published_subkey():
    key, nonce = bytes(range(32)), bytes.fromhex("000000090000004a0000000031415927") + bytes(8)
    assert subkeys(key, array(nonce)[None]).T.tobytes().hex() == "82413b4227b27bfed30e42508a877d73a0f9e4d58a74a853c12ec41326d3ecdc"


def test_published_message():
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    nonce, extra = bytes(range(0x40, 0x58)), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    (sealed,) = seal(KEY, [array(text)], array(nonce)[None], extra)
    assert sealed[:NONCE] == nonce
    assert sealed[NONCE : NONCE + 32].hex() == "bd6d179d3e83d43b9576579493c0e939572a1700252bfaccbed2902c21396cbb"
    assert sealed[-TAG:].hex() == "c0875924c1c7987947deafd8780acf49"
    assert open_sealed(KEY, [array(sealed)], extra) == [text] and open_sealed(KEY, [array(sealed)]) == [None]


def test_round_trip_of_sizes():
    rng = np.random.default_rng(1)
    values = [rng.integers(0, 256, n, dtype=np.uint8) for n in (0, 1, 15, 16, 63, 64, 65, 1000, 64 * LANES + 1, 0)]
    nonces = rng.integers(0, 256, (len(values), NONCE), dtype=np.uint8)
    together = seal(KEY, values, nonces)
    assert together == [seal(KEY, [v], n[None])[0] for v, n in zip(values, nonces)]
    assert open_sealed(KEY, [array(s) for s in together]) == [v.tobytes() for v in values]


def test_columns(spark):
    rows = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, None), (4, b""), (5, b"abd" * 100)], "id int, data binary")
    sealed = rows.select("id", "data", encrypt(F.col("data"), KEY).alias("sealed"))
    got = {r.id: r for r in sealed.select("*", decrypt(F.col("sealed"), KEY).alias("plain"), blake3(F.col("data")).alias("hash")).collect()}
    assert all(r.plain == r.data for r in got.values()) and got[3].sealed is None
    assert got[1].sealed == got[2].sealed and got[1].sealed[:NONCE].hex() == got[1].hash[: 2 * NONCE]
    broken = sealed.select("id", F.concat(F.col("sealed"), F.lit(b"x")).alias("longer"), F.substring("sealed", 1, 39).alias("short"), "sealed")
    other = broken.select(decrypt(F.col("longer"), KEY).alias("a"), decrypt(F.col("short"), KEY).alias("b"), decrypt(F.col("sealed"), KEY[::-1]).alias("c"))
    assert all(r.a is r.b is r.c is None for r in other.collect())
    with pytest.raises(ValueError):
        encrypt(F.col("data"), b"short")


def test_query(spark):
    from stowage.plans.registry import QUERIES

    rows = QUERIES["sealed_blobs"](spark, SF).collect()
    assert rows and all(r.same and r.sealed_bytes == r.size + NONCE + TAG for r in rows)
