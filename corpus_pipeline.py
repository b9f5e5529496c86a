"""A training corpus from raw documents, in five stages.

Every stage takes all rows its predecessor kept. The first four return the
columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, fertility, minhash, mixing, substring
from stowage.llm.queries import fertility_vocabularies, table, tokenizer_file
from stowage.llm.workspace import bound_batches, keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep, unchanged.

    Null and empty texts and those of under 50 words go. Repeated rows are judged alike, and null
    languages by their script. An empty table stays empty.
    """
    bound_batches(spark)
    return fertility.filter_documents(docs, *fertility_vocabularies())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of 0.8 of 5-word shingles, the one of least doc_id.

    Of repeated rows of one doc_id one stays. Rows without doc_id and texts without words (null, empty) all stay. An empty table stays empty.
    """
    bound_batches(spark)
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that occur earlier, in a smaller doc_id or the same document.

    Documents of which nothing is left go. Null texts and rows without doc_id stay as they are; rows equal in
    doc_id and text are one document. An empty table stays empty.
    """
    bound_batches(spark)
    return substring.dedup_documents(docs, threshold=50)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to even out the sources, in a global random order.

    A null source is one of its own. Repeated rows have the same count, as do rows without doc_id of the same text. An empty table stays empty.
    """
    return mixing.mix_sources(docs, alpha=0.5, epochs=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    A null text is encoded as an empty one. Every row gives one row, repeated ones too; an empty table stays empty.
    """
    bound_batches(spark)
    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    text = F.coalesce("text", F.lit(""))
    encoded = docs.select("doc_id", "lang", "source", text.alias("text"), bpe.encode_ids(text, path, pattern).alias("ids"))
    exact = bpe.decode_ids(F.col("ids"), path, pattern) == F.col("text").cast("binary")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("encode", encode),
]
#: SQL can't express the tokenisers of the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs, _ = keep(docs, f"pipeline-{name}")
    return docs
