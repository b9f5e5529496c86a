"""Removal of repeated word sequences, by seed and extend.

Seeds. Every text is winnowed: of each SPAN consecutive hashes of SEED-word
runs the least one (the first of equals) is an anchor, where SPAN + SEED - 1 is
the threshold. So every window of threshold words has exactly one anchor, at the same
place wherever its words occur. Documents are joined on anchors.

Extension. The windows that share an anchor reach some words to its left and
right; that whole stretch is hashed as the anchor's context. Anchors that agree
in it extend to the same windows both ways, so all but the first occurrence are
repeats, as a group and without forming pairs. Where contexts of one anchor
differ, its matches end inside them: there the first occurrence of each
context lays out its windows one by one, which are matched across contexts.

Repeats that overlap or touch are merged to maximal ones. A word is removed if
a window over it also starts earlier (in a smaller doc_id, or in the same
document before it). All comparisons are of 64-bit hashes of whole contexts or
windows together with their anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import join_groups, keep
from .words import Windows, shared_hashes, split_words, word_hashes

#: Words of a seed. Longer ones are shared by chance less often, but make more anchors.
SEED = 8
#: A place packs 31 bits of the text's hash and the first window start; a span the first start and how many more windows follow.
FIRST_BITS, RUN_BITS = 32, 31


def text_key(text: str | None) -> int:
    """31 bits of a text's hash, to tell texts of one doc_id apart."""
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 33


def place(key: int, first: np.ndarray) -> np.ndarray:
    return (np.int64(key) << np.int64(FIRST_BITS)) | first.astype(np.int64)


def key_of(place: Column) -> Column:
    return F.shiftright(place, FIRST_BITS).cast("int")


def span_of(place: Column, run: Column) -> Column:
    return F.shiftleft(place.bitwiseAND(F.lit((1 << FIRST_BITS) - 1)), RUN_BITS).bitwiseOR(run.cast("long"))


def anchors(hashes: np.ndarray, threshold: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Winnowed anchors of a text as parallel arrays: anchor hash, context hash, first and last
    start of the windows that have it."""
    n, seed = len(hashes), min(seed, threshold)
    none = np.zeros(0, np.int64)
    if n < threshold:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    windows = Windows(hashes)
    starts = np.arange(n - seed + 1)
    seeds = windows.of(starts, starts + seed)
    span = threshold - seed + 1
    at = np.lib.stride_tricks.sliding_window_view(seeds, span).argmin(1) + np.arange(n - threshold + 1)
    # the anchor of consecutive windows never moves back, so each has one run of windows
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:] - 1, len(at) - 1)
    # the anchor's offset in its context is part of the context
    context = windows.of(first, last + threshold) * np.uint64(2 * threshold + 1) + (at[first] - first).astype(np.uint64)
    return seeds[at[first]], context, first, last


class Columns:
    """Arrays gathered per column and given out as Arrow batches of bounded size."""

    def __init__(self, names: list[str], most: int = 200_000):
        self.names, self.most = names, most
        self.parts: list[list[np.ndarray]] = [[] for _ in names]
        self.rows = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            for part, column in zip(self.parts, columns):
                part.append(column)
            self.rows += len(columns[0])
        if self.rows > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            arrays = [pa.array(np.concatenate(part)) for part in self.parts]
            self.parts, self.rows = [[] for _ in self.names], 0
            yield pa.RecordBatch.from_arrays(arrays, names=self.names)


def emit_anchors(docs: DataFrame, threshold: int) -> DataFrame:
    """(anchor, context, doc_id, place, run) of every anchor of every text that has a doc_id; run is how many windows follow the first."""

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out = shared_hashes(), Columns(["anchor", "context", "doc_id", "place", "run"])
        for frame in frames:
            cache.trim()
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1)):
                text = text.as_py()
                anchor, context, first, last = anchors(word_hashes(split_words(text), cache), threshold)
                yield from out.add(anchor.view(np.int64), context.view(np.int64), np.full(len(first), doc_id, np.int64), place(text_key(text), first), (last - first).astype(np.int32))
        yield from out.flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(emit, "anchor long, context long, doc_id long, place long, run int")


def repeats(docs: DataFrame, threshold: int = 20) -> DataFrame:
    """(doc_id, place, run): runs of window starts whose windows occur earlier; those of a document may overlap.

    Anchors are counted before any other column is moved, so what is shuffled
    with its context is only what shares an anchor. Counting reads the texts
    once more than keeping all anchors would, and keeps none of them on disk.
    Rows find their group's count or first occurrence by ``join_groups``, so that a passage which very many
    documents share is dealt to many tasks.
    """
    found = emit_anchors(docs, threshold)
    shared, _ = keep(found.select("anchor").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    seeds, _ = keep(join_groups(found, shared, ["anchor"], ["doc_id", "place"], "inner"), "seeds")
    occurrence = F.struct("doc_id", "place")
    classes, _ = keep(seeds.groupBy("anchor", "context").agg(F.min(occurrence).alias("earliest"), F.count("*").alias("n")), "classes")
    # extension by context: all but the earliest of a class
    whole = later(join_groups(seeds, classes.where("n > 1"), ["anchor", "context"], ["doc_id", "place"], "inner"))
    # anchors of several contexts: the earliest of each context lays out its windows
    mixed, _ = keep(classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
    heads = join_groups(classes.drop("n"), mixed, ["anchor"], ["context"], "inner").select("earliest.*", F.lit(0).alias("run"))
    windows, _ = keep(lay_out(docs, heads, threshold), "windows")
    firsts, _ = keep(windows.groupBy("anchor", "window").agg(F.min(occurrence).alias("earliest"), F.count("*").alias("n")).where("n > 1"), "firsts")
    single = later(join_groups(windows, firsts, ["anchor", "window"], ["doc_id", "place"], "inner").withColumn("run", F.lit(0)))
    return whole.unionByName(single)


def later(rows: DataFrame) -> DataFrame:
    """doc_id, place and run of rows other than the earliest of their group."""
    return rows.where((F.col("doc_id") != F.col("earliest.doc_id")) | (F.col("place") != F.col("earliest.place"))).select("doc_id", "place", "run")


def with_texts(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Rows of docs (as _row) beside the list of the distinct spans of their places."""

    @F.arrow_udf(T.IntegerType())
    def key(text: pa.Array) -> pa.Array:
        return pa.array([text_key(t.as_py()) for t in text], pa.int32())

    grouped = places.groupBy("doc_id", key_of(F.col("place")).alias("text_key")).agg(F.collect_set(span_of(F.col("place"), F.col("run"))).alias("places"))
    rows = docs.select(F.struct(*docs.columns).alias("_row")).select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), key(F.col("_row.text")).alias("text_key"))
    return rows.join(grouped, ["doc_id", "text_key"], how)


def unpack(places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last window starts of spans."""
    packed = np.array(places, np.int64)
    first = packed >> RUN_BITS
    return first, first + (packed & ((1 << RUN_BITS) - 1))


def lay_out(docs: DataFrame, heads: DataFrame, threshold: int) -> DataFrame:
    """(anchor, window, doc_id, place) for each single window of the given anchors' places."""

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out = shared_hashes(), Columns(["anchor", "window", "doc_id", "place"])
        for frame in frames:
            cache.trim()
            for doc_id, text, places in zip(frame.column(0).to_pylist(), frame.column(1), frame.column(2)):
                text = text.as_py()
                hashes = word_hashes(split_words(text), cache)
                anchor, _, first, last = anchors(hashes, threshold)
                mine = np.isin(first, unpack(places.as_py())[0])
                counts = (last - first + 1)[mine]
                total = int(counts.sum())
                start = np.repeat(first[mine] - (np.cumsum(counts) - counts), counts) + np.arange(total)
                window = Windows(hashes).of(start, start + threshold).view(np.int64)
                yield from out.add(np.repeat(anchor[mine], counts).view(np.int64), window, np.full(total, doc_id, np.int64), place(text_key(text), start))
        yield from out.flush()

    once = with_texts(docs.select("doc_id", "text"), heads, "inner").select("doc_id", F.col("_row.text").alias("text"), "places")
    # repeated rows lay out equal rows, of which none is later than another
    return once.mapInArrow(emit, "anchor long, window long, doc_id long, place long")


def cut_mask(n_words: int, firsts: np.ndarray, lasts: np.ndarray, threshold: int) -> np.ndarray:
    """Words covered by the windows that start in the runs [first, last]."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, np.minimum(firsts, n_words), 1)
    np.add.at(change, np.minimum(lasts + threshold, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def without_repeats(text: str, places: list[int], threshold: int) -> tuple[int, int, bytes, str]:
    """Number of words, number removed, the kept words joined by spaces, and the text without the removed words.

    In the text each maximal repeat goes together with the white space after it.
    """
    words = split_words(text)
    if not places:
        return len(words), 0, b" ".join(words), text
    cut = cut_mask(len(words), *unpack(places), threshold)
    kept = [w for w, gone in zip(words, cut.tolist()) if not gone]
    data, at, out, keep_from = text.encode("utf-8", "surrogatepass"), 0, [], 0
    for i, word in enumerate(words):
        at = data.index(word, at)
        if cut[i] and (i == 0 or not cut[i - 1]):
            out.append(data[keep_from:at])
        if not cut[i] and i and cut[i - 1]:
            keep_from = at
        at += len(word)
    if not cut[-1]:
        out.append(data[keep_from:])
    return len(words), int(cut.sum()), b" ".join(kept), b"".join(out).decode("utf-8", "surrogatepass")


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def remove_repeats(docs: DataFrame, threshold: int = 20, with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` as _row, with n_words, n_removed, kept_sha256 and the text that is left.

    A null or empty text has no words. Rows equal in doc_id and text are one
    document and all get its result; different texts of one doc_id are ordered
    by start and then arbitrarily but consistently. Rows with a null doc_id
    lose nothing and take nothing from others. An empty table gives no rows.
    """
    @F.arrow_udf(RESULT)
    def cut(text: pa.Array, places: pa.Array) -> pa.Array:
        rows = []
        for one, found in zip(text, places):
            one = one.as_py()
            n, gone, kept, left = without_repeats(one or "", found.as_py() or [], threshold)
            rows.append((n, gone, hashlib.sha256(kept).hexdigest(), (left if one is not None else None) if with_text else None))
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=RESULT.names)

    joined = with_texts(docs, repeats(docs, threshold), "left")
    # nondeterministic: filters on its fields don't compute it again
    return joined.select("_row", cut.asNondeterministic()(F.col("_row.text"), F.col("places")).alias("_cut")).select("_row", F.col("_cut.n_words"), F.col("_cut.n_removed"), F.col("_cut.kept_sha256"), F.col("_cut.text"))


def dedup_documents(docs: DataFrame, threshold: int = 20) -> DataFrame:
    """``docs`` with repeats cut out of the texts (n_chars follows if there is one).

    Documents of which no word is left go; those that had none before stay.
    """
    cleaned = remove_repeats(docs, threshold).where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_row.{c}") for c in docs.columns]
    return cleaned.select(*columns)
