"""Registered queries of the operators and the SQL some are checked against."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm.common import table, written
from flowguard.llm.decontaminate import contaminated
from flowguard.llm import hpylm, oracles
from flowguard.llm.html_text import extract_text
from flowguard.llm.merkle import manifest
from flowguard.llm.neardup import near_components
from flowguard.llm.packing import pack, token_lengths
from flowguard.llm.prefix_trie import conversation_trie
from flowguard.llm.repeats import remove_repeats
from flowguard.llm.secrets import BASE_RULES, joined_spans, scan
from flowguard.llm.token_counts import section_counts
from flowguard.llm.token_file import encode_segments, read_documents
from flowguard.llm.topk import top_inner_products, whole_vectors
from flowguard.llm.toxicity import fit_labels, score_texts

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by a factorization machine."""
    docs = table(spark, folder, "documents")
    return score_texts(docs, fit_labels(docs, table(spark, folder, "labels")))


@_query
def op2_hpylm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under a hierarchical Pitman-Yor model."""
    return hpylm.score_texts(table(spark, folder, "documents"))


@_query
def op3_benchmark_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents within their edit budget."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query
def op4_line_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op5_top_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty best inner products of every twentieth vector against all rows."""
    return top_inner_products(whole_vectors(table(spark, folder, "embeddings")), F.col("vec_id") % 20 == 0, 20)


ORACLES["op5_top_inner_products"] = """
WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.row AS query, q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum([p[1] * p[2] for p in list_zip(q.vector, r.vector)]) AS BIGINT) AS score
  FROM whole q JOIN whole r ON q.vec_id % 20 = 0 AND r.row <> q.row
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@_query
def op6_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written as coded segments and read back."""
    segments = encode_segments(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(written(segments, "tokens"))


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


@_query
def op7_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document from the blob ledger."""
    paths, _ = scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(F.filter("spans", partial(_is_kind, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return paths.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


@_query
def op8_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket, batch and slot of every document, by its tokens."""
    docs = table(spark, folder, "documents")
    return pack(token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), F.col("n_tokens"))


@_query
def op9_minhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components over 2-word shingles."""
    return near_components(table(spark, folder, "documents"), width=2, percent=80)


@_query
def op10_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, folder, "pages"))


@_query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and verification of every document in the Merkle tree of its table."""
    return manifest(table(spark, folder, "documents"))


ORACLES["op11_merkle_manifest"] = oracles.OP11_MERKLE_MANIFEST


@_query
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie(table(spark, folder, "conversations")).drop("key")


ORACLES["op12_conversation_trie"] = oracles.OP12_CONVERSATION_TRIE


@_query
def op13_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of every document without its passages of 35 words that occur elsewhere."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    cut = remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_repeated_passages"] = oracles.OP13_REPEATED_PASSAGES
