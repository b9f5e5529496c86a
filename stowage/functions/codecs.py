"""Arrow functions for what Spark has no expression for: zstd, random test data."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def join_bytes(parts: Column) -> Column:
    """The values of an array of bytes one after the other, each copied once; null if one of them is null."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None or None in x else b"".join(x) for x in (row.as_py() for row in batch)], pa.binary())

    return run(parts)


def compress(data: Column, level: int = 3) -> Column:
    """zstd of each value; null stays null."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        import zstandard

        worker = zstandard.ZstdCompressor(level=level)
        return pa.array([None if x is None else worker.compress(x) for x in batch.to_pylist()], pa.binary())

    return run(data)


def decompress(data: Column, codec: Column | None = None) -> Column:
    """Inverse of ``compress``; values whose ``codec`` isn't 'zstd' come back as they are."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array, kinds: pa.Array) -> pa.Array:
        import zstandard

        worker = zstandard.ZstdDecompressor()
        return pa.array([x if x is None or kind != "zstd" else worker.decompress(x) for x, kind in zip(batch.to_pylist(), kinds.to_pylist())], pa.binary())

    return run(data, F.lit("zstd") if codec is None else codec)


def test_bytes(seed: Column, length: int) -> Column:
    """``length`` bytes that depend on the seed alone, as hexadecimal text of hashes."""
    words = F.transform(F.sequence(F.lit(0), F.lit((length - 1) // 32)), lambda i: F.sha2(F.concat_ws(":", seed.cast("string"), i.cast("string")), 256))
    return F.unhex(F.substring(F.array_join(words, ""), 1, 2 * length))
