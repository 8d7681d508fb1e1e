"""Packing by optimal length buckets.

Dynamic programming over the histogram of all lengths picks the bucket boundaries with the
least padding; batches of at most ``token_budget`` padded tokens form inside each bucket.
Boundaries lie on a fixed grid (every length up to 256, then steps of 1/128 of the power
of two below), so that the histogram is bounded by the logarithm of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.llm.common import bounded_batches, written
from flowguard.llm.token_counts import load_encoding

BUCKETS = 16
TOKEN_BUDGET = 16_384
FINE = 256
STEPS = 128
SHARD_ROWS = 512


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text and one end token."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and n_tokens of every row under a vocabulary file: the tokens of its text and one end token.

    Null and empty texts have the end token alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = load_encoding(ranks_path, pattern)
        for batch in batches:
            lengths = [len(encoding.encode_ordinary(text.as_py() or "")) + 1 for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def on_grid(length: Column) -> Column:
    """Smallest grid length that holds ``length``."""
    step = F.greatest(F.lit(1), F.shiftright(F.pow(F.lit(2), F.floor(F.log2(F.greatest(length, F.lit(1)) - 0.5))).cast("long"), int(np.log2(STEPS))))
    return F.when(length <= FINE, length.cast("long")).otherwise((F.ceil(length / step) * step).cast("long"))


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padded size."""
    n = len(lengths)
    if n == 0:
        return []
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        # a bucket over lengths i..j-1 pads each of its rows to lengths[j-1]
        paid = cost[None, :-1] + lengths[:, None] * (below[1:, None] - below[None, :-1])
        paid[np.arange(n)[None, :] > np.arange(n)[:, None]] = np.inf
        cut = paid.argmin(axis=1)
        cost = np.concatenate([[0], paid[np.arange(n), cut]])
        cuts.append(cut)
    bounds, end = [], n
    for cut in reversed(cuts):
        if end == 0:
            break
        bounds.append(int(lengths[end - 1]))
        end = int(cut[end - 1])
    return bounds[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Batch of every row: doc_id, n_tokens, bucket, padded_tokens, batch, slot.

    ``length`` gives the tokens of a row (words and an end token unless given); null counts
    as zero. ``bucket`` numbers the buckets from 0, ``padded_tokens`` is the bucket's
    boundary, ``batch`` is numbered within the bucket and ``slot`` within the batch. A text
    over the budget is a batch of its own. Every row is packed once, repeated and null ids
    included; only the last batch of a bucket may be short. No rows give no batches.
    """
    length = word_count(F.col("text")) if length is None else length
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    sized = written(sized.withColumn("grid", on_grid(F.col("n_tokens"))), "lengths")
    histogram = sized.groupBy("grid").agg(F.count("*").alias("rows")).orderBy("grid").collect()
    lengths, counts = np.array([r.grid for r in histogram], np.int64), np.array([r.rows for r in histogram], np.int64)
    bounds = best_boundaries(lengths, counts, buckets)
    if not bounds:
        return sized.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("padded_tokens"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"))
    held = np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds))
    upper = F.array(*[F.lit(b) for b in bounds])
    shards = F.array(*[F.lit(int(-(-h // SHARD_ROWS))) for h in held])
    placed = (
        sized.withColumn("bucket", F.size(F.filter(upper, lambda b: b < F.col("grid"))))
        .withColumn("padded_tokens", F.element_at(upper, F.col("bucket") + 1).cast("long"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.element_at(shards, F.col("bucket") + 1)).cast("int"))
    )
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "shard").agg(F.count("*").alias("rows")).select("bucket", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")
    numbered = placed.withColumn("row", F.row_number().over(inside)).join(offsets, ["bucket", "shard"])
    position = F.col("offset") + F.col("row") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("padded_tokens"))).cast("long")
    return numbered.select("doc_id", "n_tokens", "bucket", "padded_tokens", F.floor(position / capacity).cast("long").alias("batch"), (position % capacity).cast("int").alias("slot"))
