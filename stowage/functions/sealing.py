"""Convergent encryption: XChaCha20-Poly1305 with a nonce made from the plain bytes' hash.

Equal bytes under one key give equal sealed bytes, so sealed blobs still
deduplicate. Key stream blocks don't depend on each other: those of all values
of an Arrow batch are made side by side, one numpy lane each. A sealed value is
the nonce (24 bytes), the encrypted bytes, and the tag (16 bytes).
"""

from __future__ import annotations

import hmac

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .blake3 import digests

# fixed values of the specifications (RFC 8439 and the draft on XChaCha)
SIGMA = np.frombuffer(b"expand 32-byte k", "<u4")
CLAMP = 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
PRIME = (1 << 130) - 5
NONCE, TAG, BLOCK = 24, 16, 64

#: Key stream blocks made at once (1 MiB).
LANES = 16384


def quarter(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
    """The quarter round of four columns or diagonals at once, in place."""
    for first, second in ((16, 12), (8, 7)):
        a += b
        d ^= a
        d[...] = d << np.uint32(first) | d >> np.uint32(32 - first)
        c += d
        b ^= c
        b[...] = b << np.uint32(second) | b >> np.uint32(32 - second)


def rounds(state: np.ndarray) -> np.ndarray:
    """Twenty rounds over states (16, lanes)."""
    a, b, c, d = (state[i : i + 4].copy() for i in (0, 4, 8, 12))
    for _ in range(10):
        quarter(a, b, c, d)
        b, c, d = np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0)
        quarter(a, b, c, d)
        b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
    return np.concatenate([a, b, c, d])


def subkeys(key: bytes, nonces: np.ndarray) -> np.ndarray:
    """Keys (8, values) for nonces (values, 24 bytes): HChaCha20 of their first 16 bytes."""
    n = len(nonces)
    fixed = np.repeat(np.concatenate([SIGMA, np.frombuffer(key, "<u4")])[:, None], n, axis=1)
    mixed = rounds(np.concatenate([fixed, np.ascontiguousarray(nonces[:, :16]).view("<u4").T]))
    return np.concatenate([mixed[:4], mixed[12:]])


def streams(key: bytes, nonces: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each value the bytes of its block 0, which make the tag's key, and of as many more as cover its size."""
    keys, tails = subkeys(key, nonces), np.ascontiguousarray(nonces[:, 16:]).view("<u4").T
    counts = 1 + -(-sizes // BLOCK)
    starts = np.cumsum(counts) - counts
    of, total = np.repeat(np.arange(len(sizes)), counts), int(counts.sum())
    out = np.empty((total, BLOCK), np.uint8)
    for at in range(0, total, LANES):
        mine = of[at : at + LANES]
        counter = (np.arange(at, at + len(mine)) - starts[mine]).astype(np.uint32)
        state = np.concatenate([np.repeat(SIGMA[:, None], len(mine), axis=1), keys[:, mine], counter[None], np.zeros((1, len(mine)), np.uint32), tails[:, mine]])
        out[at : at + len(mine)] = np.ascontiguousarray((rounds(state) + state).T).astype("<u4").view(np.uint8)
    return [out[start : start + n].reshape(-1) for start, n in zip(starts.tolist(), counts.tolist())]


def tag(key: bytes, sealed: bytes, extra: bytes = b"") -> bytes:
    """Poly1305 of the extra data and the encrypted bytes, each padded to 16, and their lengths."""
    r, s = int.from_bytes(key[:16], "little") & CLAMP, int.from_bytes(key[16:32], "little")
    total = 0
    for part in (extra, sealed, len(extra).to_bytes(8, "little") + len(sealed).to_bytes(8, "little")):
        for at in range(0, len(part), 16):
            total = (total + int.from_bytes(part[at : at + 16], "little") + (1 << 128)) * r % PRIME
    return ((total + s) & ((1 << 128) - 1)).to_bytes(16, "little")


def seal(key: bytes, values: list[np.ndarray], nonces: np.ndarray, extra: bytes = b"") -> list[bytes]:
    out = []
    for value, nonce, stream in zip(values, nonces, streams(key, nonces, np.array([len(v) for v in values], np.int64))):
        body = (value ^ stream[BLOCK : BLOCK + len(value)]).tobytes()
        out.append(nonce.tobytes() + body + tag(stream[:32].tobytes(), body, extra))
    return out


def open_sealed(key: bytes, values: list[np.ndarray], extra: bytes = b"") -> list[bytes | None]:
    """Plain bytes; None for values that are too short or whose tag is wrong."""
    whole = [i for i, v in enumerate(values) if len(v) >= NONCE + TAG]
    out: list[bytes | None] = [None] * len(values)
    if whole:
        nonces = np.stack([values[i][:NONCE] for i in whole])
        for i, stream in zip(whole, streams(key, nonces, np.array([len(values[i]) - NONCE - TAG for i in whole], np.int64))):
            body = values[i][NONCE:-TAG]
            if hmac.compare_digest(tag(stream[:32].tobytes(), body.tobytes(), extra), values[i][-TAG:].tobytes()):
                out[i] = (body ^ stream[BLOCK : BLOCK + len(body)]).tobytes()
    return out


def check_key(key: bytes) -> bytes:
    if len(key) != 32:
        raise ValueError("a key has 32 bytes")
    return key


def encrypt(data: Column, key: bytes) -> Column:
    """Sealed bytes; the nonce is the beginning of the plain bytes' BLAKE3. Null stays null, empty bytes are sealed."""
    check_key(key)

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        values = [np.frombuffer(v.as_buffer(), np.uint8) for v in batch if v.is_valid]
        found = iter(seal(key, values, np.ascontiguousarray(digests(values)[:, :NONCE])) if values else [])
        return pa.array([next(found) if v.is_valid else None for v in batch], pa.binary())

    return run(data.cast("binary"))


def decrypt(data: Column, key: bytes) -> Column:
    """Inverse of ``encrypt``; null where the bytes aren't authentic under the key, so that such rows can be put aside."""
    check_key(key)

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        found = iter(open_sealed(key, [np.frombuffer(v.as_buffer(), np.uint8) for v in batch if v.is_valid]))
        return pa.array([next(found) if v.is_valid else None for v in batch], pa.binary())

    return run(data)
