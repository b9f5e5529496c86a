"""Words and word hashes of whole texts, for use inside Arrow batches.

A word is a run of characters other than space and U+0009 to U+000D, which is
what ``bytes.split`` yields on UTF-8. Equal words have equal 64-bit hashes in
every process (xxHash64), so hashes can be compared across executors.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash

LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Odd base of the window hashes and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


_RESIDENT: dict = {}


def resident(key: tuple, make: Callable):
    """What a Python worker keeps from one task to the next: one object, that of its last operator.

    Workers outlive stages. Taking up another operator's object drops the
    former and gives its memory back, so that a pipeline's tables don't add up.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass
        _RESIDENT[key] = make()
    return _RESIDENT[key]


class WordHashes(dict):
    """Word to hash, remembered up to ``limit`` words, then forgotten all at once."""

    def __init__(self, limit: int = 1 << 17):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.clear()


def shared_hashes() -> WordHashes:
    """The worker's word hashes."""
    return resident(("hashes",), WordHashes)


def vocabulary_file(name: str) -> str:
    """Where a vocabulary lies: an absolute path as it is, a name in this machine's own copy of the public ones."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text (null: none), with A-Z lower-cased if asked."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.translate(LOWER_ASCII) if lower else data).split()


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good diffusion (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of any run of words in O(1) each, from prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.inverse = np.empty(n + 1, np.uint64)
        powers = np.empty(n + 1, np.uint64)
        powers[0] = self.inverse[0] = 1
        powers[1:] = BASE
        self.inverse[1:] = BASE_INVERSE
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, stop); runs of different lengths differ as well."""
        raw = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(words: list[bytes], size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; fewer words form one shingle, none form none."""
    hashes = word_hashes(words, cache)
    n = len(hashes)
    if n == 0:
        return hashes
    windows = Windows(hashes)
    if n < size:
        return windows.of(np.array([0]), np.array([n]))
    starts = np.arange(n - size + 1)
    return np.unique(windows.of(starts, starts + size))
