"""Queries over the test tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotraining, fertility, langid, minhash, mixing, pq, sharding, substring, toolcalls
from .workspace import bound_batches, keep

#: Folder of the public vocabulary files; the package's own on each machine by default.
TOKENIZERS = os.environ.get("STOWAGE_TOKENIZERS", "")


def tokenizer_file(name: str) -> str:
    """A vocabulary's path, or its name, which Python workers look up where they run."""
    return os.path.join(TOKENIZERS, name) if TOKENIZERS else name


def fertility_vocabularies() -> tuple[str, str]:
    """The vocabulary with byte fallback and the byte-level one that the quality rules measure with."""
    return tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asking turn as a call with its reply linked, its position, validity and canonical JSON."""
    calls, results = toolcalls.calls_of_turns(table(spark, sf_dir, "conversations"))
    linked = toolcalls.link_calls(calls, results, toolcalls.REPLY_SCHEMAS)
    return linked.select("conv_id", "turn", "call_id", "linked", "position", "valid", "json")


OP1_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, coalesce(role IN ('assistant', 'tool'), false) AS answer FROM conversations
), calls AS (
  SELECT conv_id, turn, role, text, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id FROM turns WHERE NOT answer
), results AS (
  SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id, arg_min(text, turn) AS content, count(*) AS n
  FROM turns WHERE answer GROUP BY 1
), deps AS (
  SELECT DISTINCT c.call_id, d.call_id AS dep FROM calls c JOIN calls d ON d.conv_id = c.conv_id AND d.turn IN (c.turn - 1, c.turn - 2)
), walk AS (
  SELECT DISTINCT call_id, 0::BIGINT AS level FROM calls
  UNION
  SELECT deps.call_id, walk.level + 1 FROM walk JOIN deps ON deps.dep = walk.call_id
), levels AS (SELECT call_id, max(level) AS level FROM walk GROUP BY 1)
SELECT c.conv_id, c.turn, c.call_id, r.n IS NOT NULL AS linked, l.level AS position,
  c.text IS NOT NULL AND length(c.text) > 0 AND coalesce(c.role IN ('user', 'system'), false) AND c.turn >= 0 AS valid,
  '{"arguments":{"prompt":' || to_json(c.text)::VARCHAR || ',"role":' || to_json(c.role)::VARCHAR || ',"turn":' || c.turn::VARCHAR
  || '},"depends_on":["' || least(c.conv_id::VARCHAR || ':' || (c.turn - 1)::VARCHAR, c.conv_id::VARCHAR || ':' || (c.turn - 2)::VARCHAR)
  || '","' || greatest(c.conv_id::VARCHAR || ':' || (c.turn - 1)::VARCHAR, c.conv_id::VARCHAR || ':' || (c.turn - 2)::VARCHAR)
  || '"],"id":"' || c.call_id || '","name":"reply","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
FROM calls c LEFT JOIN results r USING (call_id) LEFT JOIN levels l USING (call_id)
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on sets of 2-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


OP2_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words
), classes AS (
  SELECT row_number() OVER (ORDER BY min(doc_id)) AS class, min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM classes a JOIN classes b ON b.n <= a.n AND 100 * b.n >= 80 * a.n AND a.rep <> b.rep
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n - len(list_intersect(a.s, b.s)))
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT rep AS node, rep AS seen FROM classes
  UNION
  SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen
), roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY 1
), labelled AS (
  SELECT x.doc_id, len(x.s) AS n_shingles, coalesce(r.root, x.doc_id) AS component_id
  FROM sets x LEFT JOIN classes c ON c.s = x.s LEFT JOIN roots r ON r.node = c.rep
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM labelled
"""


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9 or more."""
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


OP3_SQL = """
WITH RECURSIVE lengths AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings
), units AS (SELECT vec_id, list_transform(v, lambda x: x / len) AS u FROM lengths WHERE len > 0 AND isfinite(len)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
), roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY 1
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT r.node AS vec_id, coalesce(c.n, 0) AS n_links, r.root AS component_id, r.node = r.root AS kept
FROM roots r LEFT JOIN counts c ON c.a = r.node
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document at rates that even out the sources, in a global random order: whole rows are moved, then digested."""
    docs = table(spark, sf_dir, "documents")
    copies = mixing.replicate(docs, mixing.source_rates(docs))
    placed = mixing.global_positions(copies, ["_row.doc_id", "_copy"])
    return placed.select(
        "_row.doc_id", "_row.source", F.col("_copy").alias("copy_no"), F.col("position").cast("long").alias("position"), F.sha2("_row.text", 256).alias("text_sha256"),
    )


OP4_SQL = """
WITH RECURSIVE sizes AS (
  SELECT coalesce('=' || source, 'null') AS s, sum(greatest(strlen(coalesce(text, '')), 1))::BIGINT AS size FROM documents GROUP BY 1
), weights AS (SELECT s, size, pow(size, 0.5) AS weight FROM sizes
), rates AS (
  SELECT s, (SELECT sum(size) FROM weights)::BIGINT * (weight / (SELECT sum(weight) FROM weights)) / size AS rate FROM weights
), walk AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS f FROM rates
  UNION ALL
  SELECT s, rate, k + 1, p * rate / (k + 1), f + p * rate / (k + 1) FROM walk WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), draws AS (
  SELECT doc_id, source, sha256(text) AS text_sha256, coalesce('=' || source, 'null') AS s,
    ('0x' || sha256(doc_id::VARCHAR || '|copies0|1')[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, d.text_sha256, count(*) AS n FROM draws d JOIN walk w ON w.s = d.s AND w.f <= d.u GROUP BY 1, 2, 3
), copies AS (
  SELECT doc_id, source, text_sha256, unnest(range(n::BIGINT))::INT AS copy_no FROM counted
)
SELECT doc_id, source, copy_no, text_sha256, row_number() OVER (
  ORDER BY ('0x' || sha256(doc_id::VARCHAR || '|order0|' || copy_no::VARCHAR)[1:13])::BIGINT, doc_id, copy_no) - 1 AS position
FROM copies
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the mixture of largest proportion."""
    found = langid.identify_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word sequences that occur earlier, as digests."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 20, with_text=False)
    return found.select("_row.doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM starts
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), cut AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeated
), cuts AS (SELECT doc_id, list(p) AS ps FROM cut GROUP BY 1
), kept AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(c.ps), 0) AS n_removed,
    CASE WHEN c.ps IS NULL THEN array_to_string(w.w, ' ')
      ELSE array_to_string(list_transform(list_filter(list_zip(w.w, range(1, len(w.w) + 1)), lambda x: NOT list_contains(c.ps, x[2])), lambda x: x[1]), ' ') END AS t
  FROM words w LEFT JOIN cuts c USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(t) AS kept_sha256 FROM kept
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the rank queue, and what they decode to, as digests."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility metrics and verdict of every document."""
    features = fertility.quality_features(table(spark, sf_dir, "documents"), *fertility_vocabularies())
    metrics = fertility.with_metrics(keep(features, "fertility")[0])
    judged = fertility.judge(metrics, keep(fertility.fertility_bands(metrics), "bands")[0])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "n_byte_tokens", "n_byte_level_tokens", F.round("chars_per_token", 6).alias("chars_per_token"), F.round("entropy", 6).alias("entropy"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, by a ring with bounded loads."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 40)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by two co-trained views."""
    docs = table(spark, sf_dir, "documents")
    scored = cotraining.score_documents(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("score_text", "score_meta", "score")], "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toolcalls": op1_toolcalls,
    "op2_minhash": op2_minhash,
    "op3_embeddings": op3_embeddings,
    "op4_mixing": op4_mixing,
    "op5_language": op5_language,
    "op6_substring": op6_substring,
    "op7_bpe": op7_bpe,
    "op8_fertility": op8_fertility,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = {"op1_toolcalls": OP1_SQL, "op2_minhash": OP2_SQL, "op3_embeddings": OP3_SQL, "op4_mixing": OP4_SQL, "op6_substring": OP6_SQL}
