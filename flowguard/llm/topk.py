"""Exact top-k inner products by pivot-table elimination.

The distances of every vector to a few dozen pivots are computed once and travel with it.
For a query the largest difference of pivot distances bounds the true distance from below,
which bounds the inner product from above: ``2 q.x = |q|^2 + |x|^2 - d(q, x)^2``.
Candidates are evaluated in the order of that bound until no remaining bound reaches the
k-th best score. Blocks of queries meet blocks of candidates by an equi-join on the pair
of block numbers, so no task holds more than one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.llm.common import written

PIVOTS = 24
SAMPLE = 512
QUERY_BLOCK = 1024
ROW_BLOCK = 16_384
FIRST = 256
SLACK = 1e-5


def farthest_first(vectors: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from one another, taken greedily from a sample."""
    chosen = [0]
    away = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(vectors)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for every vector length in a sample of ``SAMPLE`` rows, the smallest hashes of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    sizes: dict[int, list] = {}
    for r in rows:
        sizes.setdefault(len(r.vector), []).append(r.vector)
    return {n: farthest_first(np.array(v, dtype=np.float64).reshape(len(v), n), PIVOTS) for n, v in sizes.items()}


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, width)


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with a number per row and the distances to the pivots of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = []
            for vector in batch.column(1):
                x = np.asarray(vector.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                known = pivots.get(len(x))
                distances.append(np.zeros(0) if known is None else np.sqrt(((known - x) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distances, pa.list_(pa.float64()))], [*batch.schema.names, "distances"])

    numbered = vectors.select("vec_id", "vector", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(run, "vec_id long, vector array<long>, row long, distances array<double>")


def best_in_block(queries: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row id, score) of the k best rows of a block for each query of a block."""
    width, nq, nx = len(queries.column("vector")[0]), queries.num_rows, rows.num_rows
    ids = rows.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    q, x = _matrix(queries.column("vector"), width, nq), _matrix(rows.column("vector"), width, nx)[order]
    if width and max(np.abs(q).max(), np.abs(x).max()) ** 2 * width < 2**53:
        q, x = q.astype(np.float64), x.astype(np.float64)
    pivots = len(queries.column("distances")[0])
    dq, dx = _matrix(queries.column("distances"), pivots, nq), _matrix(rows.column("distances"), pivots, nx)[order].T.copy()
    q2, x2 = (q.astype(np.float64) ** 2).sum(axis=1), (x.astype(np.float64) ** 2).sum(axis=1)
    own, numbers = queries.column("row").to_numpy(), rows.column("row").to_numpy()[order]
    found = [], [], []
    gap, least = np.empty(nx), np.empty(nx)
    for i in range(nq):
        least.fill(0)
        for p in range(pivots):
            np.subtract(dx[p], dq[i, p], out=gap)
            np.maximum(least, np.abs(gap, out=gap), out=least)
        total = q2[i] + x2
        bound = (total - least**2) / 2 + SLACK * (1 + total)
        bound[numbers == own[i]] = -np.inf
        seen = np.argpartition(bound, nx - FIRST)[nx - FIRST :] if nx > FIRST else np.arange(nx)
        score = x[seen] @ q[i]
        score, seen = score[np.isfinite(bound[seen])], seen[np.isfinite(bound[seen])]
        last = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
        bound[seen] = -np.inf
        rest = np.flatnonzero((bound >= last) & (bound > -np.inf))
        rest = rest[np.argsort(-bound[rest], kind="stable")]
        at = 0
        while at < len(rest) and bound[rest[at]] >= last:
            part = rest[at : at + 1024]
            at += len(part)
            value = x[part] @ q[i]
            useful = value >= last
            seen, score = np.concatenate([seen, part[useful]]), np.concatenate([score, value[useful]])
            if len(score) >= k:
                last = np.partition(score, len(score) - k)[len(score) - k]
        best = np.lexsort((ids[seen], -score))[:k]
        found[0].append(np.full(len(best), own[i])), found[1].append(ids[seen[best]]), found[2].append(score[best].astype(np.int64))
    return tuple(np.concatenate([*f, np.zeros(0, np.int64)]).astype(np.int64) for f in found)


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def whole_vectors(rows: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and floor(scale * component) of the vectors without null or non-finite components."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("vector"))


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k best rows of every query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and an array of whole numbers (see ``whole_vectors``). A query
    meets every row of its own vector length except itself; ties go to the smaller id;
    fewer rows give fewer ranks. Rows that repeat an id are candidates, and queries, of their
    own, whatever their vectors. An empty table gives no rows.
    """
    table = written(pivot_table(vectors, choose_pivots(vectors)), "pivots")
    total = table.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks, query_blocks = max(1, -(-total[0] // ROW_BLOCK)), max(1, -(-total[1] // QUERY_BLOCK))
    size = F.size("vector").alias("size")
    columns = ["vec_id", "vector", "row", "distances"]
    queries = table.where(is_query).select(size, F.pmod(F.xxhash64("row"), F.lit(query_blocks)).alias("a"), F.explode(_numbers(row_blocks)).alias("b"), *columns)
    rows = table.select(size, F.explode(_numbers(query_blocks)).alias("a"), F.pmod(F.xxhash64("row"), F.lit(row_blocks)).alias("b"), *columns)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        query, row, score = best_in_block(left, right, k) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * 3
        at = left.column("row").to_numpy() if left.num_rows else np.zeros(0, np.int64)
        order = np.argsort(at)
        names = left.column("vec_id").to_numpy()[order][np.searchsorted(at[order], query)] if len(query) else query
        return pa.table({"query": query, "query_id": names, "vec_id": row, "score": score})

    found = queries.groupBy("size", "a", "b").cogroup(rows.groupBy("size", "a", "b")).applyInArrow(meet, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
