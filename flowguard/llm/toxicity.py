"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: letter words in lower case and their prefixes of
four to six letters, which catch inflected stems. The machine scores
``b + sum(w_i) + sum over pairs (v_i . v_j)``, so that it learns combinations that single
weights miss. It is fitted on a bounded sample of labelled rows, and only terms whose
label odds differ most get weights, which keeps the model small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import CACHE_WORDS, bounded_batches, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
HASH_BITS = 22
THRESHOLD = 0.7


@dataclass(frozen=True)
class FactorizationConfig:
    """Bounds and rates of the fit.

    ``sample_rows`` labelled rows at most are used, taken in hash order of their ids;
    ``max_terms`` terms at most get weights, each seen in ``min_rows`` sampled rows or more
    and with a label count ``least_surplus`` standard deviations or more from the expected.
    """

    sample_rows: int = 16_000
    max_terms: int = 6_000
    min_rows: int = 3
    least_surplus: float = 4.5
    factors: int = 8
    epochs: int = 30
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 17


@dataclass(frozen=True)
class FactorizationModel:
    """Weights of the known terms: sorted hashed ids, linear weights and factors."""

    bias: float
    ids: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray) -> float:
        """Probability that a text with the terms at these positions is toxic."""
        chosen = self.factors[at]
        pairs = ((chosen.sum(axis=0) ** 2) - (chosen**2).sum(axis=0)).sum() / 2
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.linear[at].sum() + pairs, -500, 500))))


def word_terms(word: str) -> list[int]:
    """Hashed ids of a word and of its prefixes."""
    names = [f"w:{word}"] + [f"p:{word[:k]}" for k in PREFIXES if len(word) >= k]
    return [xxhash.xxh64_intdigest(n.encode("utf-8", "surrogatepass")) >> (64 - HASH_BITS) for n in names]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = {t for w in set(WORD.findall((text.as_py() or "").lower())) for t in word_terms(w)}
            rows.append(sorted(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "terms", "toxic"])


def labelled_terms(docs: DataFrame, labels: DataFrame, config: FactorizationConfig) -> tuple[list[np.ndarray], np.ndarray]:
    """Term sets and labels of the sampled training rows, at most ``sample_rows`` of them.

    The terms are counted in Spark; the driver gets the telling ones and the sets cut to them.
    Labels count only where crc32 of the id's text leaves a remainder other than 1 by 3.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(config.seed)), "doc_id").limit(config.sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = written(texts.mapInArrow(_terms, "doc_id long, terms array<int>, toxic int").dropDuplicates(["doc_id"]), "terms")
    total, hits = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = hits / max(1, total)
    spread = F.sqrt(F.greatest(F.col("n") * share * (1 - share), F.lit(1e-9)))
    counts = rows.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    ranked = counts.where(F.col("n") >= config.min_rows).withColumn("surplus", F.abs(F.col("p") - F.col("n") * share) / spread)
    best = ranked.where(F.col("surplus") >= config.least_surplus).orderBy(F.desc("surplus"), "term").limit(config.max_terms)
    terms = np.sort(np.array([r.term for r in best.select("term").collect()], dtype=np.int32))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(x.values.to_numpy(), terms) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "terms", "toxic"])

    few = rows.mapInArrow(chosen, rows.schema).collect()
    few.sort(key=lambda r: r.doc_id)
    return [np.array(r.terms, dtype=np.int32) for r in few], np.array([r.toxic for r in few], dtype=np.float64)


def fit(term_sets: list[np.ndarray], toxic: np.ndarray, config: FactorizationConfig = FactorizationConfig()) -> FactorizationModel:
    """Factorization machine by Adam on the logistic loss; without rows every score is the neutral 0.5."""
    sizes = np.array([len(x) for x in term_sets], dtype=np.int64)
    flat = np.concatenate(term_sets) if len(term_sets) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ids, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    positive = np.bincount(column, weights=toxic[row], minlength=len(ids)) if len(ids) else np.zeros(0)
    total, hits = len(toxic), toxic.sum()
    share = hits / max(1, total)
    surplus = np.abs(positive - counts * share) / np.sqrt(np.maximum(counts * share * (1 - share), 1e-9))
    rank = np.where(counts >= config.min_rows, surplus, -1)
    chosen = np.sort(np.argsort(-rank, kind="stable")[: config.max_terms])
    chosen = chosen[rank[chosen] >= config.least_surplus]
    place = np.full(len(ids), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0 if len(ids) else np.zeros(0, bool)
    row, column = row[keep], place[column[keep]] if len(ids) else column
    begins = np.searchsorted(row, np.arange(total + 1))

    random = np.random.default_rng(config.seed)
    n, k = len(chosen), config.factors
    rate = (hits + 0.5) / (total + 1)
    params = [np.array([np.log(rate / (1 - rate))]), np.zeros(n), random.normal(0, 0.02, (n, k))]
    means, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(config.epochs if 0 < hits < total else 0):
        for batch in np.array_split(random.permutation(total), max(1, total // config.batch)):
            take = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in batch])
            local = np.repeat(np.arange(len(batch)), begins[batch + 1] - begins[batch])
            terms, (bias, linear, factors) = column[take], params
            sums = np.zeros((len(batch), k))
            np.add.at(sums, local, factors[terms])
            own = np.bincount(local, weights=linear[terms] - (factors[terms] ** 2).sum(axis=1) / 2, minlength=len(batch))
            value = bias[0] + own + (sums**2).sum(axis=1) / 2
            weight = np.where(toxic[batch] > 0, min(5.0, ((1 - rate) / rate) ** 0.5), 1.0)
            error = weight * (1 / (1 + np.exp(-np.clip(value, -50, 50))) - toxic[batch]) / len(batch)
            slope = np.zeros_like(factors)
            np.add.at(slope, terms, error[local, None] * (sums[local] - factors[terms]))
            slopes = [np.array([error.sum()]), np.bincount(terms, weights=error[local], minlength=n) + config.decay * linear, slope + config.decay * factors]
            step += 1
            for p, m, s, g in zip(params, means, squares, slopes):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= config.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    bias = float(params[0][0]) if total else 0.0
    return FactorizationModel(bias, ids[chosen].astype(np.int64), params[1], params[2])


def fit_labels(docs: DataFrame, labels: DataFrame, config: FactorizationConfig = FactorizationConfig()) -> FactorizationModel:
    return fit(*labelled_terms(docs, labels, config), config)


class TextScorer:
    """Scores texts; remembers which terms of a word have weights."""

    def __init__(self, model: FactorizationModel):
        self.model, self.place, self.words = model, {t: i for i, t in enumerate(model.ids.tolist())}, {}

    def __call__(self, text: str | None) -> float:
        found: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            at = self.words.get(word)
            if at is None:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                at = self.words[word] = tuple(self.place[t] for t in word_terms(word) if t in self.place)
            found.update(at)
        return self.model.score(np.array(sorted(found), dtype=np.int64))


def score_texts(docs: DataFrame, model: FactorizationModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null or empty text has no terms and gets the score of the bias alone. A null id
    leaves held_out null. Repeated rows are scored alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TextScorer(model)
        for batch in batches:
            scores = [scorer(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: FactorizationModel) -> DataFrame:
    """The rows whose score stays below the threshold, every column unchanged."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TextScorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer(text.as_py()) < THRESHOLD for text in batch.column(at)], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
