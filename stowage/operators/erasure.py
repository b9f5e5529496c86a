"""Erasure coding of shards over GF(256), and reconstruction of lost pieces.

Parity piece i is the sum of the data pieces times the entries of row i of a Cauchy
matrix; any N of the N + K pieces determine the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import join_bytes


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(512, np.int64), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        exp[i], log[x] = x, i
        x <<= 1
        if x & 256:
            x ^= 0x11D
    exp[255:510] = exp[:255]
    return exp, log


EXP, LOG = _tables()


def multiply(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]])


def inverse(a: int) -> int:
    return int(EXP[(255 - LOG[a]) % 255])


def matrix(n: int, k: int) -> np.ndarray:
    """(N + K) x N: the identity above a Cauchy matrix."""
    if n + k > 256:
        raise ValueError("N + K must not exceed 256")
    cauchy = np.array([[inverse((n + i) ^ j) for j in range(n)] for i in range(k)], np.int64).reshape(k, n)
    return np.concatenate((np.eye(n, dtype=np.int64), cauchy))


def invert(m: np.ndarray) -> np.ndarray:
    """Inverse over GF(256) by elimination."""
    n = len(m)
    work = np.concatenate((m.copy(), np.eye(n, dtype=np.int64)), axis=1)
    for col in range(n):
        pivot = col + int(np.flatnonzero(work[col:, col])[0])
        work[[col, pivot]] = work[[pivot, col]]
        work[col] = multiply(work[col], inverse(int(work[col, col])))
        for row in range(n):
            if row != col and work[row, col]:
                work[row] ^= multiply(work[col], int(work[row, col]))
    return work[:, n:]


def combine(rows: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Linear combinations of pieces (a matrix of bytes)."""
    table = multiply(np.arange(256)[:, None], np.arange(256)).astype(np.uint8)
    out = np.zeros((len(rows), pieces.shape[1]), np.uint8)
    for i, row in enumerate(rows):
        for factor, piece in zip(row, pieces):
            if factor:
                out[i] ^= table[factor][piece]
    return out


#: Pieces are coded byte by byte, so a shard is dealt out in stripes of this many bytes of each piece.
STRIPE = 1 << 20


def striped(parts: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """Parts of pieces (shard_id, piece_index, offset, data) cut at the borders of stripes; offsets are then within the stripe."""
    end = F.col("offset") + F.length("data")
    numbers = F.sequence(F.floor(F.col("offset") / stripe), F.floor(F.greatest(end - 1, F.col("offset")) / stripe))
    cut = parts.select("shard_id", F.col("piece_index").cast("int"), F.col("offset").cast("long"), "data", F.explode(numbers).alias("stripe"))
    begin = F.greatest(F.col("offset"), F.col("stripe") * stripe)
    part = F.substring("data", (begin - F.col("offset") + 1).cast("int"), (F.least(end, (F.col("stripe") + 1) * stripe) - begin).cast("int"))
    return cut.select("shard_id", "stripe", "piece_index", (begin - F.col("stripe") * stripe).alias("offset"), part.alias("data"))


def whole_pieces(stripes: DataFrame, *also: Column) -> DataFrame:
    """(shard_id, piece_index, data, …) from the stripes of each piece in order."""
    rows = F.array_sort(F.collect_list(F.struct(*[c for c in stripes.columns if c not in ("shard_id", "piece_index")])))
    grouped = stripes.groupBy("shard_id", "piece_index").agg(rows.alias("_s"))
    return grouped.select("shard_id", "piece_index", join_bytes(F.transform("_s", lambda x: x["data"])).alias("data"), *also)


def encode(pieces: DataFrame, n: int, k: int, piece_size: int, stripe: int = STRIPE) -> DataFrame:
    """All N + K pieces (shard_id, piece_index, data, piece_hash, shard_hash) of each shard from its data pieces (shard_id, piece_index, data).

    With a column offset, rows are parts of pieces, each at its place in the piece. Data pieces are padded with
    zeros to ``piece_size``, absent ones are all zeros. A shard's hash is of the hashes of its stripes in order,
    each of the data pieces' bytes there. The N pieces of one stripe meet in a task, never those of a whole shard.
    """
    stripe = min(stripe, piece_size)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["stripe"].iloc[0])
        data = np.zeros((n, min(stripe, piece_size - number * stripe)), np.uint8)
        for index, offset, value in zip(group["piece_index"], group["offset"], group["data"]):
            data[index, offset : offset + len(value)] = np.frombuffer(value, np.uint8)
        raw = [p.tobytes() for p in np.concatenate((data, combine(matrix(n, k)[n:], data)))]
        return pd.DataFrame({"shard_id": group["shard_id"].iloc[0], "piece_index": range(n + k), "stripe": number, "data": raw, "stripe_hash": hashlib.sha256(b"".join(raw[:n])).hexdigest()})

    offset = F.col("offset") if "offset" in pieces.columns else F.lit(0).alias("offset")
    parts = striped(pieces.select("shard_id", "piece_index", offset, "data"), stripe)
    # stripes without any data are all zeros
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(-(-piece_size // stripe) - 1).cast("long"))
    every = pieces.select("shard_id").distinct().select("shard_id", F.explode(numbers).alias("stripe"), F.lit(0).alias("piece_index"), F.lit(0).cast("long").alias("offset"), F.lit(b"").alias("data"))
    coded = parts.unionByName(every).groupBy("shard_id", "stripe").applyInPandas(run, "shard_id long, piece_index int, stripe long, data binary, stripe_hash string")
    shard_hash = F.sha2(F.array_join(F.transform("_s", lambda x: x["stripe_hash"]), ""), 256)
    return whole_pieces(coded, shard_hash.alias("shard_hash")).select("shard_id", "piece_index", "data", F.sha2("data", 256).alias("piece_hash"), "shard_hash")


def reconstruct(pieces: DataFrame, n: int, k: int, stripe: int = STRIPE) -> DataFrame:
    """The missing data pieces (shard_id, piece_index, data) of shards with N valid pieces or more.

    Pieces whose data hasn't their piece_hash don't count, nor do repeated ones. Shards with fewer
    valid pieces, or with all data pieces, give no rows. Stripes are recovered apart from each other.
    """
    sound = pieces.where(F.sha2("data", 256) == F.col("piece_hash")).select("shard_id", "piece_index", F.lit(0).alias("offset"), "data")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("piece_index").sort_values("piece_index").iloc[:n]
        have = group["piece_index"].to_numpy()
        lost = [i for i in range(n) if i not in set(have.tolist())]
        if len(have) < n or not lost:
            return pd.DataFrame({"shard_id": [], "piece_index": [], "stripe": [], "data": []})
        raw = combine(invert(matrix(n, k)[have])[lost], np.stack([np.frombuffer(v, np.uint8) for v in group["data"]]))
        return pd.DataFrame({"shard_id": group["shard_id"].iloc[0], "piece_index": lost, "stripe": group["stripe"].iloc[0], "data": [r.tobytes() for r in raw]})

    return whole_pieces(striped(sound, stripe).drop("offset").groupBy("shard_id", "stripe").applyInPandas(run, "shard_id long, piece_index int, stripe long, data binary"))


def any_copy(pieces: DataFrame) -> DataFrame:
    """Mirrored shards: one valid copy of each (the least piece hash and data)."""
    return pieces.where(F.sha2("data", 256) == F.col("piece_hash")).groupBy("shard_id").agg(F.min(F.struct("piece_hash", "data")).alias("c")).select("shard_id", "c.data")


def xor_parity(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Parity of integers per group (K = 1), without Python."""
    return rows.groupBy(group).agg(F.bit_xor(value).alias("parity"), F.count("*").alias("pieces"))
