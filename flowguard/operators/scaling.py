"""Column scaling fitted with one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.operators.quantiles import column_percentiles


@dataclass(frozen=True)
class Scaler:
    """Per-column center and scale."""

    kind: str
    columns: tuple[str, ...]
    centers: tuple[float, ...]
    scales: tuple[float, ...]

    def expressions(self) -> dict[str, Column]:
        return {
            n: (F.col(n) - c) / s for n, c, s in zip(self.columns, self.centers, self.scales)
        }

    def transform(self, df: DataFrame, prefix: str = "scaled_") -> DataFrame:
        return df.withColumns({f"{prefix}{n}": e for n, e in self.expressions().items()})


def scaling_statistics(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """One row of centers and scales as an array per column."""
    if kind == "standard":
        pair = lambda n: F.array(F.avg(n), F.stddev_pop(n))
    elif kind == "robust":
        def pair(n: str) -> Column:
            q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            return F.array(F.get(q, F.lit(1)), F.get(q, F.lit(2)) - F.get(q, F.lit(0)))
    else:
        raise ValueError("scaler is 'standard' or 'robust'")
    return df.agg(*[pair(n).alias(n) for n in columns])


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "standard") -> Scaler:
    """Fit on every row; constant columns keep scale one."""
    kind = kind.strip().lower()
    if kind == "robust":
        quarters = column_percentiles(df, {n: [25, 50, 75] for n in columns})
        pairs = [(q[1], None if None in q else q[2] - q[0]) for q in map(quarters.get, columns)]
    else:
        row = scaling_statistics(df, columns, kind).first()
        pairs = [tuple(row[n]) for n in columns]
    centers = tuple(float(c or 0.0) for c, _ in pairs)
    scales = tuple(float(s) if s else 1.0 for _, s in pairs)
    return Scaler(kind, tuple(columns), centers, scales)
