"""BLAKE3-256 as an Arrow function, by the published specification.

A value is cut into chunks of 1,024 bytes, the leaves of a binary tree whose
nodes are all made by one compression. Chunks don't depend on each other, so
those of many values are compressed side by side, one numpy lane each; then the
trees of all values are folded level by level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the specification
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = np.array([2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8])
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
ROUNDS, BLOCK, CHUNK = 7, 64, 1024

#: Chunks that are compressed at once (4 MiB of data).
LANES = 4096


def mix(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """The quarter round of four columns or diagonals at once, in place."""
    for word, first, second in ((x, 16, 12), (y, 8, 7)):
        a += b
        a += word
        d ^= a
        d[...] = d >> np.uint32(first) | d << np.uint32(32 - first)
        c += d
        b ^= c
        b[...] = b >> np.uint32(second) | b << np.uint32(32 - second)


def compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8, lanes) of blocks (16, lanes)."""
    lanes = chain.shape[1]
    a, b = chain[:4].copy(), chain[4:].copy()
    c = np.repeat(IV[:4, None], lanes, axis=1)
    d = np.stack([counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)])
    for _ in range(ROUNDS):
        mix(a, b, c, d, words[0:8:2], words[1:8:2])
        b, c, d = np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0)
        mix(a, b, c, d, words[8::2], words[9::2])
        b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
        words = words[PERMUTATION]
    return np.concatenate([a ^ c, b ^ d])


def leaves(data: np.ndarray, sizes: np.ndarray, counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values of chunks: rows of CHUNK bytes of which ``sizes`` count; those ``alone`` in their value are its root."""
    words = data.view("<u4").T
    last = np.maximum(-(-sizes // BLOCK), 1) - 1
    chain = np.repeat(IV[:, None], len(sizes), axis=1)
    for block in range(int(last.max()) + 1):
        on = np.flatnonzero(last >= block)
        ends = last[on] == block
        flags = CHUNK_START * (block == 0) + np.where(ends, CHUNK_END + ROOT * alone[on], 0)
        chain[:, on] = compress(chain[:, on], words[16 * block : 16 * block + 16, on], counter[on], np.clip(sizes[on] - BLOCK * block, 0, BLOCK), flags)
    return chain


def pieces(values: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(bytes, number of the first chunk, alone) of at most LANES chunks of one value."""
    for value in values:
        for at in range(0, max(len(value), 1), LANES * CHUNK):
            yield value[at : at + LANES * CHUNK], at // CHUNK, len(value) <= CHUNK


def digests(values: list[np.ndarray]) -> np.ndarray:
    """The 32-byte BLAKE3 hashes of byte arrays, as rows."""
    if not values:
        return np.zeros((0, 32), np.uint8)
    done: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, int, bool]] = []

    def flush() -> None:
        counts = [max(-(-len(piece) // CHUNK), 1) for piece, _, _ in waiting]
        data, sizes = np.zeros((sum(counts), CHUNK), np.uint8), np.full(sum(counts), CHUNK)
        at, flat = 0, data.reshape(-1)
        for (piece, _, _), n in zip(waiting, counts):
            flat[at * CHUNK : at * CHUNK + len(piece)] = piece
            sizes[at + n - 1] = len(piece) - (n - 1) * CHUNK
            at += n
        counter = np.concatenate([np.arange(first, first + n, dtype=np.uint64) for (_, first, _), n in zip(waiting, counts)])
        done.append(leaves(data, sizes, counter, np.repeat([alone for _, _, alone in waiting], counts)))
        waiting.clear()

    lanes = 0
    for piece in pieces(values):
        more = max(-(-len(piece[0]) // CHUNK), 1)
        if waiting and lanes + more > LANES:
            flush()
            lanes = 0
        waiting.append(piece)
        lanes += more
    flush()
    nodes, counts = np.concatenate(done, axis=1), np.array([max(-(-len(v) // CHUNK), 1) for v in values])
    while counts.max() > 1:
        # neighbours are joined; the last of an odd number moves up as it is
        position = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        of = np.repeat(counts, counts)
        left = np.flatnonzero(position % 2 == 0)
        up, both = nodes[:, left], position[left] + 1 < of[left]
        pair = left[both]
        flags = PARENT + ROOT * (of[pair] == 2)
        words = np.concatenate([nodes[:, pair], nodes[:, pair + 1]])
        up[:, both] = compress(np.repeat(IV[:, None], len(pair), axis=1), words, np.zeros(len(pair), np.uint64), np.full(len(pair), BLOCK), flags)
        nodes, counts = up, -(-counts // 2)
    return np.ascontiguousarray(nodes.T).astype("<u4").view(np.uint8)


def blake3(data: Column) -> Column:
    """BLAKE3 of bytes or UTF-8 text in lowercase hexadecimal; null stays null, empty values have a hash."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        known = [value for value in batch if value.is_valid]
        found = iter(digests([np.frombuffer(value.as_buffer(), np.uint8) for value in known]))
        return pa.array([next(found).tobytes().hex() if value.is_valid else None for value in batch], pa.string())

    return run(data.cast("binary"))
