"""Exact percentiles that never gather a column in one task."""

from __future__ import annotations

from math import ceil, floor, inf, nextafter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BINS = 1024
_GATHER = 10_000
_LARGEST = nextafter(inf, 0.0)


def exact_percentiles(df: DataFrame, column: str, percentages: list[float], gather: int = _GATHER) -> list[float]:
    """Linear-interpolation percentiles of one column."""
    found = column_percentiles(df, {column: percentages}, gather)[column]
    if None in found:
        raise ValueError("percentile of no rows")
    return found


def column_percentiles(df: DataFrame, wanted: dict[str, list[float]], gather: int = _GATHER) -> dict[str, list[float | None]]:
    """Percentiles of several columns, located side by side.

    Each pass is one scan: the interval that holds a wanted order statistic is cut into
    1,024 bins, counted with partial aggregation, and the bin of the statistic is the next
    interval. Intervals of at most ``gather`` rows are read out. Nulls are left out and NaN
    counts as infinity; a column without values has null percentiles.
    """
    names = list(wanted)
    cell = lambda n: F.when(F.isnan(n), F.lit(inf)).otherwise(F.col(n))
    bounded = lambda n: F.greatest(F.least(cell(n), F.lit(_LARGEST)), F.lit(-_LARGEST))
    values = df.select(*[F.col(n).cast("double").alias(n) for n in names]).select(*[F.when(F.col(n).isNotNull(), bounded(n)).alias(n) for n in names])
    ends = values.agg(*[F.struct(F.count(n).alias("n"), F.min(n).alias("low"), F.max(n).alias("high")).alias(n) for n in names]).first()
    places = {n: [(ends[n].n - 1) * p / 100.0 for p in wanted[n]] for n in names if ends[n].n}
    # (column, rank) -> (low, high, rank inside, rows inside)
    open_ranks = {(n, r): (ends[n].low, ends[n].high, r, ends[n].n) for n in places for x in places[n] for r in (floor(x), ceil(x))}
    found: dict[tuple[str, int], float] = {}
    while open_ranks:
        found |= {k: low for k, (low, high, _, _) in open_ranks.items() if low == high}
        open_ranks = {k: v for k, v in open_ranks.items() if k not in found}
        few = {k: v for k, v in open_ranks.items() if v[3] <= gather}
        for k, rows in _read_out(values, few).items():
            found[k] = rows[few[k][2]]
        open_ranks = _narrow(values, {k: v for k, v in open_ranks.items() if k not in found})
    value = lambda n, r: {_LARGEST: inf, -_LARGEST: -inf}.get(found[n, r], found[n, r])

    def between(n: str, x: float) -> float:
        below, above = value(n, floor(x)), value(n, ceil(x))
        return below if below == above else below + (above - below) * (x - floor(x))

    return {n: [between(n, x) for x in places[n]] if n in places else [None] * len(wanted[n]) for n in names}


def _inside(values: DataFrame, intervals: list[tuple[str, float, float]], cell) -> DataFrame:
    """One row (interval, x, extra) per value inside an interval."""
    parts = [F.when(F.col(n).between(low, high), F.struct(F.lit(i).alias("at"), F.col(n).alias("x"), cell(F.col(n), low, high).alias("bin"))) for i, (n, low, high) in enumerate(intervals)]
    return values.select(F.inline(F.array_compact(F.array(*parts))))


def _read_out(values: DataFrame, few: dict) -> dict:
    """Sorted values of intervals that hold few rows."""
    spans = list(dict.fromkeys((n, low, high) for (n, _), (low, high, _, _) in few.items()))
    if not spans:
        return {}
    rows: dict[int, list[float]] = {}
    for r in _inside(values, spans, lambda x, low, high: F.lit(0)).groupBy("at").agg(F.sort_array(F.collect_list("x")).alias("x")).collect():
        rows[r.at] = r.x
    return {(n, rank): rows[spans.index((n, low, high))] for (n, rank), (low, high, _, _) in few.items()}


def _narrow(values: DataFrame, ranks: dict) -> dict:
    """The bin of every rank, from one histogram per interval."""
    spans = list(dict.fromkeys((n, low, high) for (n, _), (low, high, _, _) in ranks.items()))
    if not spans:
        return {}
    place = lambda x, low, high: F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * _BINS), F.lit(_BINS - 1)).cast("int")
    bins: dict[int, list] = {}
    # at most _BINS rows per interval
    for b in _inside(values, spans, place).groupBy("at", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at", "bin").collect():
        bins.setdefault(b.at, []).append(b)
    nearer = {}
    for (n, name), (low, high, rank, _) in ranks.items():
        for b in bins[spans.index((n, low, high))]:
            if rank < b.n:
                nearer[n, name] = (b.low, b.high, rank, b.n)
                break
            rank -= b.n
    return nearer
