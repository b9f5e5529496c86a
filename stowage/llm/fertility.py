"""Quality rules from tokeniser fertility, with rejection bands per language or script.

A public vocabulary with byte fallback splits every word. Per document this
gives characters per token, tokens per word, the share of byte-fallback tokens and the
entropy of its tokens relative to the most that so many tokens can have; a second, byte-level
vocabulary gives characters per token once more. What
is usual differs between languages and between lengths; so the
bands are medians of the corpus per language (or script, where the language is
null) and per quarter of a doubling of the token count, give or take some interquartile ranges.
A class of size is its documents and PRIOR imagined ones, spread as those of the classes around it
are, the nearest first. So a band moves smoothly with length, and few documents or many are treated alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .words import resident, split_words, vocabulary_file
from .workspace import join_groups, keep

SYMBOLS = b"#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
#: First code points of the scripts told apart; letters below U+0250 count as Latin.
SCRIPT_STARTS = np.array([0x41, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x1100, 0x1E00, 0x3040, 0x3100, 0x3400, 0xAC00, 0xD800])
SCRIPT_NAMES = ["other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "hangul", "latin", "kana", "cjk", "cjk", "hangul", "other"]

FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "n_byte_level_tokens")]
    + [T.StructField("entropy", T.DoubleType()), T.StructField("script", T.StringType())]
)


class WordTable(dict):
    """Words to codes, with the tokens, characters and symbols of each; bounded by ``limit``."""

    def __init__(self, model: str, ranks: str, limit: int = 1 << 17):
        import sentencepiece
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        super().__init__()
        self.limit = limit
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        # a word is one piece, led by a space as in running text
        self.byte_level = tiktoken.Encoding("byte-level", pat_str=r"[\s\S]+", mergeable_ranks=load_tiktoken_bpe(ranks), special_tokens={})
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[bytes] = []
        self.chars = self.symbols = self.lengths = self.starts = self.n_bytes = self.byte_lengths = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code

    def settle(self) -> None:
        """Tokenise the words that are new."""
        if not self.new:
            return
        words, self.new = self.new, []
        texts = [w.decode("utf-8", "replace") for w in words]
        split = self.model.encode(texts, num_threads=1)
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        tokens = np.fromiter((t for s in split for t in s), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(split)), lengths)
        self.n_bytes = np.concatenate((self.n_bytes, np.bincount(owner[self.is_byte[tokens]], minlength=len(split))))
        self.byte_lengths = np.concatenate((self.byte_lengths, np.fromiter((len(self.byte_level.encode_ordinary(" " + t)) for t in texts), np.int64, len(texts))))
        self.chars = np.concatenate((self.chars, np.fromiter(map(len, texts), np.int64, len(texts))))
        self.symbols = np.concatenate((self.symbols, np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in words), np.int64, len(words))))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.tokens = np.concatenate((self.tokens, tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths


def word_table(model: str, ranks: str) -> WordTable:
    """The worker's word table of two vocabularies."""
    return resident(("words", model, ranks), lambda: WordTable(vocabulary_file(model), vocabulary_file(ranks)))


def repeat_words(codes: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    if len(codes) < 4:
        return 0
    if codes.max() < 1 << 21:
        windows = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:  # pairs are numbered first, so that any codes fit
        _, pairs = np.unique((codes[:-2] << 32) | codes[1:-1], return_inverse=True)
        windows = (pairs << 32) | codes[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(codes), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return len(lines) - len(set(lines))


def main_script(text: str) -> str:
    """The script with the most letters; ties go to the first in SCRIPT_NAMES."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(np.searchsorted(SCRIPT_STARTS, points[points >= 0x41], side="right"), minlength=len(SCRIPT_NAMES))
    total: dict[str, int] = {}
    for name, count in zip(SCRIPT_NAMES[1:], counts[1:].tolist()):
        total[name] = total.get(name, 0) + count
    best = max(total, key=total.get)
    return best if total[best] else "other"


def batch_features(texts: list[str | None], table: WordTable) -> list[tuple]:
    """A row of FEATURES for each text."""
    if len(table) > table.limit:
        table.clear()
    split = [split_words(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((c for words in split for c in map(table.__getitem__, words)), np.int64, int(lengths.sum()))
    table.settle()
    edges = np.concatenate(([0], np.cumsum(lengths)))
    owner = np.repeat(np.arange(len(texts)), lengths)

    def total(values: np.ndarray) -> list[int]:
        sums = np.concatenate(([0], np.cumsum(values[flat])))
        return (sums[edges[1:]] - sums[edges[:-1]]).tolist()

    counts = table.lengths[flat]
    at = np.repeat(table.starts[flat] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    tokens = np.sort((np.repeat(owner, counts) << 32) | table.tokens[at])
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    each = np.diff(np.append(first, len(tokens)))
    n_tokens = total(table.lengths)
    weighted = np.bincount(tokens[first] >> 32, weights=each * np.log2(each), minlength=len(texts)) if len(tokens) else np.zeros(len(texts))
    rows = []
    for i, (text, n, chars, symbols, n_byte, n_level) in enumerate(zip(texts, n_tokens, total(table.chars), total(table.symbols), total(table.n_bytes), total(table.byte_lengths))):
        entropy = float((np.log2(n) - weighted[i] / n) / np.log2(n)) if n > 1 else 0.0
        rows.append((int(lengths[i]), chars, symbols, dup_lines(text or ""), repeat_words(flat[edges[i] : edges[i + 1]]), n, n_byte, n_level, max(0.0, entropy), main_script(text or "")))
    return rows


def text_features(text: Column, model: str, ranks: str) -> Column:
    """Struct column FEATURES of each whole text; a null text has no words.

    Marked nondeterministic so that filters on its fields don't compute it again.
    """

    @F.arrow_udf(FEATURES)
    def features(batch: pa.Array) -> pa.Array:
        table = word_table(model, ranks)
        texts = batch.to_pylist()
        rows = [row for begin, end in _slices(texts, 2_000_000) for row in batch_features(texts[begin:end], table)]
        columns = list(zip(*rows)) if rows else [()] * len(FEATURES)
        kinds = [pa.int64()] * 8 + [pa.float64(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=FEATURES.names)

    return features.asNondeterministic()(text)


#: How far each metric may lie below and above the median, in spreads.
REACH = {
    "chars_per_token": (4.5, 6.0),
    "chars_per_byte_level_token": (4.5, 6.0),
    "tokens_per_word": (6.0, 7.0),
    "byte_share": (8.0, 8.0),
    "entropy": (2.75, 7.0),
}
#: Metrics are counted in bins of a thousandth, or of 1/128 of a doubling.
BY_DOUBLINGS = ("chars_per_token", "chars_per_byte_level_token", "tokens_per_word")
#: A spread is the interquartile range, but this share of the median (and SMALL) at least.
LEAST_SPREAD, SMALL = 0.02, 0.005
#: Classes of size per doubling of the token count.
SIZES = 4
#: Bands that are broadcast at most.
MOST_BANDS = 20_000
#: Documents that the classes around one lend it; a class counts half as much as the one before it, up to AROUND away.
PRIOR, AROUND = 25.0, 8


def with_metrics(features: DataFrame) -> DataFrame:
    """Adds the metrics and the keys of the bands; needs FEATURES' columns and ``lang``."""
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    return features.withColumns(
        {
            "chars_per_token": F.col("word_chars") / tokens,
            "chars_per_byte_level_token": F.col("word_chars") / F.greatest(F.col("n_byte_level_tokens"), F.lit(1)),
            "tokens_per_word": F.col("n_tokens") / F.greatest(F.col("n_words"), F.lit(1)),
            "byte_share": F.col("n_byte_tokens") / tokens,
            "band_group": F.coalesce(F.col("lang"), F.concat(F.lit("script:"), F.col("script"))),
            "band_size": F.floor(SIZES * F.log2(tokens)).cast("int"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def bin_of(metric: str) -> Column:
    value = F.col(metric)
    return F.floor(128 * F.log2(F.greatest(value, F.lit(2.0**-10))) if metric in BY_DOUBLINGS else 1000 * value).cast("int")


def bin_value(bin_: Column, metric: str) -> Column:
    """The middle of a bin."""
    middle = bin_ + 0.5
    return F.pow(F.lit(2.0), middle / 128) if metric in BY_DOUBLINGS else middle / 1000


def fertility_bands(metrics: DataFrame) -> DataFrame:
    """Lowest and highest usual value of each metric per band_group and band_size, and n, the number of rows there.

    Quartiles are over all documents that pass the base rules, counted in bins; documents with
    the same metrics, such as exact copies, count once. The only document of a language is
    its own band. Nothing wider than the bins of one class meets in a task.
    """
    key = ["band_group", "band_size"]
    usable = metrics.where(~F.col("base_failed")).select(*key, "n_words", *REACH).distinct()
    binned = usable.select(*key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(m).alias("bin")) for m in REACH])).alias("b"))
    counts, _ = keep(binned.groupBy(*key, "b.metric", "b.bin").agg(F.count("*").alias("n")), "band-counts")
    present = counts.select(*key).distinct()
    steps = F.explode(F.sequence(F.lit(-AROUND), F.lit(AROUND))).alias("step")
    around = counts.select("band_group", "band_size", "metric", "bin", "n", steps).select(
        "band_group", (F.col("band_size") + F.col("step")).alias("band_size"), "metric", "bin", F.when(F.col("step") == 0, F.col("n")).otherwise(0).alias("own"),
        (F.col("n") * F.pow(F.lit(0.5), F.abs("step"))).alias("near"),
    )
    cells = around.join(present, key, "left_semi").groupBy(*key, "metric", "bin").agg(F.sum("own").alias("own"), F.sum("near").alias("near"))
    whole = Window.partitionBy(*key, "metric")
    weight = F.col("own") + PRIOR * F.col("near") / F.sum("near").over(whole)
    cells = cells.withColumn("weight", weight).withColumn("all", F.sum("own").over(whole) + PRIOR)
    # rounding may leave the last sum a little short
    cells = cells.withColumn("below", F.sum("weight").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + 1e-6)
    quartile = lambda q, m: bin_value(F.min(F.when((F.col("metric") == m) & (F.col("below") >= q * F.col("all")), F.col("bin"))), m)
    bands = cells.groupBy(*key).agg(*[quartile(q, m).alias(f"{m}_{i}") for m in REACH for i, q in enumerate((0.25, 0.5, 0.75))])
    out = []
    for m, (below, above) in REACH.items():
        low, middle, high = (F.col(f"{m}_{i}") for i in range(3))
        spread = F.greatest(high - low, LEAST_SPREAD * middle, F.lit(SMALL))
        out += [(middle - below * spread).alias(f"{m}_low"), (middle + above * spread).alias(f"{m}_high")]
    sizes = metrics.groupBy(*key).agg(F.count("*").alias("n"))
    return bands.join(sizes, key).select(*key, "n", *out)


def judge(metrics: DataFrame, bands: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds ``kept``: the base rules hold and each metric is in its band.

    ``bands`` is a written table with a row per language and size class of the corpus. Up to MOST_BANDS
    rows (some 2 MB) are broadcast, so that no text is moved; of more, large classes are dealt out by ``doc_id``.
    Documents without a band (every one of their class fails the base rules) are not kept.
    """
    inside = F.lit(True)
    for m in REACH:
        inside = inside & (F.col(m) >= F.col(f"{m}_low")) & (F.col(m) <= F.col(f"{m}_high"))
    key = ["band_group", "band_size"]
    joined = metrics.join(F.broadcast(bands.drop("n")), key, "left") if bands.count() <= MOST_BANDS else join_groups(metrics, bands, key, [doc_id, "entropy"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality_features(docs: DataFrame, model: str, ranks: str) -> DataFrame:
    """doc_id, lang and FEATURES of every row, nothing else of the input."""
    return docs.select("doc_id", "lang", text_features(F.col("text"), model, ranks).alias("_f")).select("doc_id", "lang", "_f.*")


def filter_documents(docs: DataFrame, model: str, ranks: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged.

    Features are computed once for the bands and once more beside the texts:
    that costs CPU time but moves no text between executors. Null texts and
    texts of under 50 words fail; repeated rows are judged alike; an empty
    table gives an empty table; the input's other columns pass through.
    """
    features, _ = keep(quality_features(docs, model, ranks), "fertility")
    bands, _ = keep(fertility_bands(with_metrics(features)), "bands")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("lang"), text_features(F.col("text"), model, ranks).alias("_f"))
    judged = judge(with_metrics(packed.select("_row", "lang", "_f.*")), bands, "_row.doc_id")
    return judged.where("kept").select("_row.*")
