"""Quality scores by co-training a text-content and a page-metadata classifier.

Both views are logistic regressions. They start from labelled documents and
then, for a few rounds, each labels those of all other documents it is
sure of, for the other view to learn from. A held-out part of the labels
calibrates the two views and fits the weights of their combination, which
scores all documents.

The labels of MOST_LABELLED documents, chosen by hash, are used. All other documents
are unlabelled ones: every round scores all of them, and each of Newton's steps adds up gradients
and Hessians of all labelled and confident rows where they lie, so only sums reach the driver.
Each round starts from the weights of the last one and takes STEPS steps, which is enough to settle
to some 1e-3; so all documents are read rounds x STEPS times, as half-precision views of some 550 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .words import WordHashes, shared_hashes, split_words, word_hashes
from .workspace import discard, keep

MOST_LABELLED = 8000
#: Newton's steps of a round over all documents.
STEPS = 2
WORD_BUCKETS = 256
SOURCE_BUCKETS = 64
LANG_BUCKETS = 16
SIZE_BUCKETS = 24

#: Classes of bytes that the text view counts.
CLASSES = np.zeros((8, 256), np.float32)
CLASSES[0, ord("A") : ord("Z") + 1] = 1
CLASSES[1, ord("a") : ord("z") + 1] = 1
CLASSES[2, ord("0") : ord("9") + 1] = 1
CLASSES[3, list(b"#*$%&|<>")] = 1
CLASSES[4, list(b".,;:!?'\"()-")] = 1
CLASSES[5, ord(" ")] = 1
CLASSES[6, ord("\n")] = 1
CLASSES[7, 128:] = 1
TEXT_SIZE = WORD_BUCKETS + len(CLASSES) + 6
META_SIZE = SOURCE_BUCKETS + LANG_BUCKETS + SIZE_BUCKETS + 1


def text_view(texts: list[str | None], cache: WordHashes) -> np.ndarray:
    """Hashed words (signed roots of counts, unit length) and shares of style, one row per text, rounded to half precision."""
    out = np.zeros((len(texts), TEXT_SIZE), np.float32)
    cache.trim()
    for i, text in enumerate(texts):
        words = split_words(text)
        out[i, -1] = 1
        if not words:
            continue
        hashes = word_hashes(words, cache)
        signs = np.where(hashes & np.uint64(1 << 20), 1.0, -1.0)
        counts = np.bincount((hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), weights=signs, minlength=WORD_BUCKETS)
        counts = np.sign(counts) * np.sqrt(np.abs(counts))
        out[i, :WORD_BUCKETS] = counts / max(1e-9, np.sqrt((counts**2).sum()))
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        out[i, WORD_BUCKETS : WORD_BUCKETS + len(CLASSES)] = CLASSES @ np.bincount(data, minlength=256) / len(data)
        lines = text.split("\n")
        out[i, -6:-1] = (
            np.log1p(len(words)) / 10,
            len(data) / len(words) / 10,
            len(np.unique(hashes)) / len(words),
            1 - len(set(lines)) / len(lines),
            np.log1p(len(lines)) / 10,
        )
    # as precise as what the models are fitted on
    return out.astype(np.float16).astype(np.float32)


META_OFFSETS = np.array([0, SOURCE_BUCKETS, SOURCE_BUCKETS + LANG_BUCKETS])


def meta_codes(sources: list, langs: list, sizes: list) -> np.ndarray:
    """Bucket of the hashed source and language, and the size in octaves (0: null or empty), one row per page."""
    sources = [xxhash.xxh64_intdigest(f"s{s}") % SOURCE_BUCKETS for s in sources]
    langs = [xxhash.xxh64_intdigest(f"l{s}") % LANG_BUCKETS for s in langs]
    octaves = [0 if s is None or s < 1 else min(SIZE_BUCKETS - 1, int(np.log2(s)) + 1) for s in sizes]
    return np.array([sources, langs, octaves], np.uint8).reshape(3, -1).T


def meta_view(codes: np.ndarray) -> np.ndarray:
    """Codes one-hot, and the intercept."""
    out = np.zeros((len(codes), META_SIZE), np.float32)
    out[np.arange(len(codes))[:, None], codes + META_OFFSETS] = 1
    out[:, -1] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last column is the intercept."""
    x = x.astype(np.float64)
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (y - p)) - penalty * beta
        curve = (x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    """Weights of both views, and of (text logit, metadata logit, 1) in the calibrated combination."""

    text: np.ndarray
    meta: np.ndarray
    calibration: np.ndarray
    combination: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated score of each view and the combined one."""
        logits = [np.clip(text @ self.text, -30, 30), np.clip(meta @ self.meta, -30, 30)]
        sides = [1 / (1 + np.exp(-(a * z + b))) for z, (a, b) in zip(logits, self.calibration)]
        both = self.combination
        return *sides, 1 / (1 + np.exp(-(both[0] * logits[0] + both[1] * logits[1] + both[2])))


def newton_step(slope: np.ndarray, curve: np.ndarray, beta: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """The step from ``beta`` by the sums of all rows; the last column is the intercept."""
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-6
    return np.linalg.solve(curve + np.diag(penalty), slope - penalty * beta)


def unpacked(frame: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The two views of rows whose packed forms are columns ``first`` and the next one."""
    text, meta = (b"".join(frame.column(i).to_pylist()) for i in (first, first + 1))
    return np.frombuffer(text, np.float16).reshape(frame.num_rows, -1).astype(np.float32), meta_view(np.frombuffer(meta, np.uint8).reshape(frame.num_rows, -1))


def chance(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


#: Rows of sums are added up in this many tasks before they go to the driver.
SUMMED = 8


def sums(features: DataFrame, givers: list[np.ndarray] | None, betas: list[np.ndarray], sure: float, unsure: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and Hessian of each view's likelihood at ``betas``.

    Rows are the labelled ones outside the fold that calibrates and, if there are ``givers``, the
    unlabelled ones that the other view's weights are sure of, with weight 0.3.
    """
    widths = [len(b) for b in betas]
    shared = features.sparkSession.sparkContext.broadcast((givers, betas))

    def partial(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        givers, betas = shared.value
        total = [np.zeros((w, w + 1)) for w in widths]
        for frame in frames:
            label, fold = frame.column(0).to_numpy(), frame.column(1).to_numpy(zero_copy_only=False)
            both = unpacked(frame, 2)
            for taker in (0, 1):
                y = np.where(fold, -1, label)
                if givers is not None:
                    p = chance(both[1 - taker], givers[1 - taker])
                    y = np.where(label < 0, np.where(p >= sure, 1, np.where(p <= unsure, 0, -1)), y)
                on = y >= 0
                x, weights = both[taker][on], np.where(label[on] >= 0, 1.0, 0.3)
                p = chance(x, betas[taker])
                total[taker][:, 0] += x.T.astype(np.float64) @ (weights * (y[on] - p))
                # a step's direction may be in single precision, its target may not
                total[taker][:, 1:] += (x * (weights * p * (1 - p) + 1e-9)[:, None].astype(np.float32)).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMMED], pa.int32()), pa.array([b"".join(t.tobytes() for t in total)], pa.binary())], names=["task", "total"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t, np.float64) for t in group.column("total").to_pylist())
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    parts = features.select("label", "fold", "text", "meta").mapInArrow(partial, "task int, total binary").groupBy("task").applyInArrow(add, "total binary").collect()
    flat = sum((np.frombuffer(r.total, np.float64) for r in parts), np.zeros(sum(w * (w + 1) for w in widths)))
    out = []
    for w in widths:
        both, flat = flat[: w * (w + 1)].reshape(w, w + 1), flat[w * (w + 1) :]
        out.append((both[:, 0], both[:, 1:]))
    return out


def climb(rows: DataFrame, givers: list[np.ndarray] | None, weights: list[np.ndarray], sure: float, unsure: float, steps: int) -> list[np.ndarray]:
    """Both views' weights after at most ``steps`` steps of Newton's method."""
    for _ in range(steps):
        step = [newton_step(*s, beta) for s, beta in zip(sums(rows, givers, weights, sure, unsure), weights)]
        weights = [beta + s for beta, s in zip(weights, step)]
        if max(np.abs(s).max() for s in step) < 1e-6:
            break
    return weights


def co_train(features: DataFrame, rounds: int = 3, sure: float = 0.98, unsure: float = 0.1, steps: int = STEPS) -> Model:
    """Co-training on rows of label (0, 1 or -1), fold (true where labels only calibrate), text and meta.

    Without labels of both classes in both parts every score is the share of ones (0.5 without any).
    """
    counts = {(r.fold, r.label): r.n for r in features.where("label >= 0").groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        known = sum(counts.values())
        share = np.clip(sum(n for (_, label), n in counts.items() if label) / known if known else 0.5, 1e-6, 1 - 1e-6)
        odds = np.log(share / (1 - share))
        return Model(np.zeros(TEXT_SIZE), np.zeros(META_SIZE), np.array([[1, odds], [1, odds]]), np.array([0, 0, odds]))
    labelled, path = keep(features.where("label >= 0"), "co-training-labelled")
    weights = climb(labelled, None, [np.zeros(TEXT_SIZE), np.zeros(META_SIZE)], sure, unsure, 12)
    for _ in range(rounds):
        weights = climb(features, weights, weights, sure, unsure, steps)
    shared = features.sparkSession.sparkContext.broadcast(weights)

    def logits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [np.clip(x @ w, -30, 30) for x, w in zip(unpacked(frame, 1), shared.value)]
            yield pa.RecordBatch.from_arrays([frame.column(0), *map(pa.array, found)], names=["label", "a", "b"])

    held = labelled.where("fold").select("label", "text", "meta").mapInArrow(logits, "label int, a double, b double")
    held = np.array([tuple(r) for r in held.groupBy("label", "a", "b").agg(F.count("*").alias("n")).orderBy("a", "b", "label").collect()], np.float64)
    discard(features.sparkSession, path)
    truth, sides, many, ones = held[:, 0], held[:, 1:3].T, held[:, 3], np.ones(len(held))
    calibration = np.stack([fit_logistic(np.stack((z, ones), 1), truth, many, 0.01) for z in sides])
    combination = fit_logistic(np.stack((*sides, ones), 1), truth, many, 0.01)
    return Model(weights[0], weights[1], calibration, combination)


def views(docs: DataFrame) -> list[Column]:
    size = F.coalesce(F.col("n_chars"), F.length("text")).cast("long")
    return [F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string"), size]


def training_rows(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """label, fold, text and meta (packed) of every row of ``docs``; label is -1 but for the labelled documents taken."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    taken = marked.orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(most_labelled)

    @F.arrow_udf("struct<text:binary,meta:binary,fold:boolean>")
    def view(doc_id: pa.Array, text: pa.Array, source: pa.Array, lang: pa.Array, size: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        a = [row.tobytes() for begin, end in _slices(texts, 2_000_000) for row in text_view(texts[begin:end], shared_hashes()).astype(np.float16)]
        b = [row.tobytes() for row in meta_codes(source.to_pylist(), lang.to_pylist(), size.to_pylist())]
        folds = [xxhash.xxh64_intdigest(f"fold{i}") % 3 == 0 for i in doc_id.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(folds, pa.bool_())], names=["text", "meta", "fold"])

    # the ids taken are bounded by the parameter, so they may be broadcast
    rows = docs.join(F.broadcast(taken), "doc_id", "left").select(F.coalesce("label", F.lit(-1)).alias("label"), view(F.col("doc_id"), *views(docs)).alias("v"))
    return rows.select("label", "v.fold", "v.text", "v.meta")


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """Fit from the labels (several of one document: their mean, half counts as 1) and all other documents."""
    features, path = keep(training_rows(docs, labels, most_labelled), "co-training")
    model = co_train(features)
    discard(docs.sparkSession, path)
    return model


SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score_text", "score_meta", "score")])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, both views' calibrated scores, their combination, and kept (score >= threshold).

    Every row is scored from its whole text; null texts have no words, null
    metadata is a value of its own; repeated rows score alike; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SCORES)
    def score(text: pa.Array, source: pa.Array, lang: pa.Array, size: pa.Array) -> pa.Array:
        cache = shared_hashes()
        texts = text.to_pylist()
        content = [text_view(texts[a:b], cache) for a, b in _slices(texts, 2_000_000)]
        content = np.concatenate(content) if content else np.zeros((0, TEXT_SIZE))
        found = shared.value.scores(content, meta_view(meta_codes(source.to_pylist(), lang.to_pylist(), size.to_pylist())))
        return pa.StructArray.from_arrays([pa.array(s, pa.float64()) for s in found], names=SCORES.names)

    scored = docs.select("doc_id", score(*views(docs)).alias("_s")).select("doc_id", "_s.*")
    return scored.withColumn("kept", F.col("score") >= threshold)
