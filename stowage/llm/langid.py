"""Language proportions of documents by expectation-maximisation.

A document is a mixture: each word is drawn from one of the languages, whose
letter trigrams give the word's likelihood. EM estimates the proportions, and
the set of languages is the one of highest penalised likelihood found by
removing languages one after the other: each language costs half the logarithm
of the number of words, and two words' worth of chance hits.

Trigrams are of UTF-8 bytes of lower-cased words with a space at both ends,
hashed to BUCKETS values, so a model has languages x BUCKETS numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .words import resident, split_words

BUCKETS = 1 << 15
#: A model is sent to every executor; learning fails beyond this many languages (64 MB).
MOST_LANGUAGES = 512
UNDETERMINED = "und"


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of consecutive words, and each word's number of them (its length)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b" " + b" ".join(words) + b"  ", np.uint8).astype(np.uint32)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    between = np.cumsum(lengths + 1) - 1  # trigrams around the space after each word
    inside = np.ones(len(codes), bool)
    inside[between] = False
    inside[int(lengths.sum()) + len(words) :] = False
    return ((codes[inside] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64), lengths


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities (languages x BUCKETS) from rows with text and lang.

    Counts are over all rows given; each task emits one row per language and
    bucket at most. Null texts and null languages teach nothing.
    """

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                words = split_words(text.lower())
                if words:
                    if lang not in totals:
                        totals[lang] = np.zeros(BUCKETS, np.int64)
                    totals[lang] += np.bincount(trigrams(words)[0], minlength=BUCKETS)
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    taught = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = taught.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row per language holds its whole model: BUCKETS numbers at most
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).limit(MOST_LANGUAGES + 1)
    rows = sorted(packed.collect(), key=lambda r: r.lang)
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    model = np.full((len(rows), BUCKETS), 0.5)
    for i, row in enumerate(rows):
        cells = np.array([(c.bucket, c.n) for c in row.cells], np.int64)
        model[i, cells[:, 0]] += cells[:, 1]
    return [r.lang for r in rows], np.log(model / model.sum(1, keepdims=True)).astype(np.float32) if rows else model.astype(np.float32)


class WordLikelihoods(dict):
    """Words to codes, and the log-likelihood of each word in each language; bounded by ``limit``."""

    def __init__(self, model: np.ndarray, limit: int = 1 << 17):
        super().__init__()
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[bytes] = []
        self.values = np.zeros((len(self.model), 0), np.float32)

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code

    def settle(self) -> None:
        if self.new:
            buckets, lengths = trigrams(self.new)
            starts = np.cumsum(lengths) - lengths
            fresh = np.stack([np.add.reduceat(row[buckets], starts) for row in self.model])
            self.values = np.concatenate((self.values, fresh.astype(np.float32)), axis=1)
            self.new = []


#: Steps of EM between two looks at whether a document has settled, and how many such rounds there are at most.
STEPS, ROUNDS = 5, 40
#: A document has settled when no proportion moves by more in a step.
SETTLED = 1e-4


def mixtures(likelihoods: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Proportions (documents x languages) of documents with a word each at least.

    ``likelihoods`` is languages x words, in logarithms; document i has the words
    edges[i] to edges[i + 1], each ``counts`` times. After one round over all languages a document goes on with those
    that have half a word or more, so further work doesn't grow with the number of languages. Then EM runs until it settles,
    and the least language is removed, again until it settles, for as long as that loses less likelihood than the penalty.
    """
    n_langs, n_docs = len(likelihoods), len(edges) - 1
    chance = np.exp(likelihoods - likelihoods.max(0))
    n_words = np.add.reduceat(counts, edges[:-1])
    penalty = 0.5 * np.log(n_words) + 2.0

    def climb(docs: np.ndarray, langs: np.ndarray, weights: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """EM from ``weights`` (documents x their ``langs``); proportions and log-likelihood."""
        weights, fit, active = weights.copy(), np.zeros(len(docs), np.float32), np.arange(len(docs))
        for _ in range(rounds):
            sizes = np.diff(edges)[docs[active]]
            first = np.cumsum(sizes) - sizes
            mine = np.repeat(np.arange(len(active)), sizes)
            at = np.arange(len(mine)) + np.repeat(edges[docs[active]] - first, sizes)
            c, p = counts[at], [chance[langs[active, k][mine], at] for k in range(langs.shape[1])]
            now = weights[active]
            for _ in range(STEPS):
                each = [now[mine, k] * p[k] for k in range(len(p))]
                share = c / np.maximum(sum(each), np.float32(1e-30))
                before, now = now, np.stack([np.add.reduceat(e * share, first) for e in each], axis=1)
                now /= now.sum(1, keepdims=True)
            mass = np.maximum(sum(now[mine, k] * p[k] for k in range(len(p))), np.float32(1e-30))
            weights[active], fit[active] = now, np.add.reduceat(c * np.log(mass), first)
            active = active[np.abs(now - before).max(1) > SETTLED]
            if not len(active):
                break
        return weights, fit

    docs = np.arange(n_docs)
    every = np.broadcast_to(np.arange(n_langs), (n_docs, n_langs))
    weights, _ = climb(docs, every, np.full((n_docs, n_langs), 1 / n_langs, np.float32), 1)
    langs = np.argsort(-weights, axis=1, kind="stable")
    weights = np.take_along_axis(weights, langs, 1)
    weights[:, 1:][weights[:, 1:] * n_words[:, None] < 0.5] = 0
    most = int((weights > 0).sum(1).max())
    langs, weights = langs[:, :most], weights[:, :most] / weights.sum(1, keepdims=True)
    weights, fit = climb(docs, langs, weights, ROUNDS)
    docs = docs[(weights > 0).sum(1) > 1]
    while len(docs):
        trial = weights[docs]
        trial[np.arange(len(docs)), np.where(trial > 0, trial, np.inf).argmin(1)] = 0
        trial /= trial.sum(1, keepdims=True)
        better, new_fit = climb(docs, langs[docs], trial, ROUNDS)
        accept = fit[docs] - new_fit <= penalty[docs]
        docs = docs[accept]
        weights[docs], fit[docs] = better[accept], new_fit[accept]
        docs = docs[(weights[docs] > 0).sum(1) > 1]
    out = np.zeros((n_docs, n_langs), np.float32)
    np.put_along_axis(out, langs, weights, 1)
    return out


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType()))])


def batch_predict(texts: list[str | None], langs: list[str], table: WordLikelihoods) -> list[tuple]:
    """(language, its proportion, languages of the mixture by proportion) of each text."""
    if len(table) > table.limit:
        table.clear()
    out: list[tuple] = [(UNDETERMINED, 0.0, [])] * len(texts)
    if not langs:
        return out
    at, codes, counts, sizes = [], [], [], []
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            mine = np.array(list(map(table.__getitem__, split_words(text.lower()))), np.int64)
            distinct, n = np.unique(mine, return_counts=True)
            at.append(i)
            codes.append(distinct)
            counts.append(n)
            sizes.append(len(distinct))
    if not at:
        return out
    table.settle()
    edges = np.concatenate(([0], np.cumsum(sizes)))
    weights = mixtures(table.values[:, np.concatenate(codes)], np.concatenate(counts).astype(np.float32), edges)
    for i, row in zip(at, weights):
        order = np.argsort(-row, kind="stable")
        out[i] = (langs[order[0]], min(1.0, float(row[order[0]])), [langs[k] for k in order if row[k] > 0])
    return out


def predict(text: Column, langs: list[str], model: np.ndarray, spark) -> Column:
    """Struct column: best language, its proportion, and the languages of the mixture.

    A text without a letter, a null one, or a model without languages gives
    ``und`` and 0. Ties go to the language that comes first in order.
    """
    shared = spark.sparkContext.broadcast(model)
    # likelihoods are languages x words
    most = 2_000_000 * 8 // max(8, len(langs))
    name = ("likelihoods", uuid.uuid4().hex)

    @F.arrow_udf(RESULT)
    def identify(batch: pa.Array) -> pa.Array:
        table = resident(name, lambda: WordLikelihoods(shared.value))
        texts = batch.to_pylist()
        rows = [row for begin, end in _slices(texts, most) for row in batch_predict(texts[begin:end], langs, table)]
        pred, score, found = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))], names=RESULT.names)

    return identify(text)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from; null ids are not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and langs of every row.

    Learns from rows that are not held out and have a doc_id. Repeated rows
    are predicted alike; an empty table gives no rows; other columns are not read.
    """
    taught = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    langs, model = learn(taught)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), langs, model, docs.sparkSession).alias("_p"))
    return out.select("doc_id", "held_out", "_p.*")
