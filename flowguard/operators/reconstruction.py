"""Linear reconstruction-error detector."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.functions.scalar import bind
from flowguard.operators.quantiles import exact_percentiles
from flowguard.operators.scaling import Scaler, fit_scaler
from flowguard.operators.scores import ScoreStats, collect_stats, log_error, normalise_score, with_verdict
from flowguard.session import cut_lineage


@dataclass(frozen=True)
class Reconstruction:
    """Scaler, projection (features x components) and error threshold."""

    scaler: Scaler
    components: tuple[tuple[float, ...], ...]
    threshold: float = 0.0
    stats: ScoreStats | None = None

    @property
    def features(self) -> list[str]:
        return list(self.scaler.columns)


def bottleneck(width: int) -> int:
    """Components kept for ``width`` features."""
    return min(max(8, max(4, width // 2)), max(1, width - 1))


def fit_components(
    df: DataFrame, scaler: Scaler, components: int | None = None, variance: float = 0.95
) -> Reconstruction:
    """Principal components of the scaled rows, from one distributed covariance.

    Unless ``components`` is given, the fewest that explain ``variance`` are kept, up
    to the bottleneck width; columns that repeat each other would otherwise leave
    nothing to reconstruct.
    """
    width = len(scaler.columns)
    scaled = list(scaler.expressions().values())
    vectors = df.select(array_to_vector(F.array(*scaled)).alias("x"))
    model = PCA(k=components or bottleneck(width), inputCol="x", outputCol="y").fit(vectors)
    matrix = model.pc.toArray()
    if components is None:
        explained = model.explainedVariance.toArray().cumsum()
        matrix = matrix[:, : max(1, int((explained < variance).sum()) + 1)]
    return Reconstruction(scaler, tuple(tuple(map(float, r)) for r in matrix))


def reconstruction_error(model: Reconstruction) -> Column:
    """Mean squared difference between a scaled row and its projection.

    Scaled rows are centred, so the projection needs no offset.
    """
    scaled = list(model.scaler.expressions().values())
    return _residual(scaled, model.components)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _residual(scaled: list[Column], components: tuple[tuple[float, ...], ...]) -> Column:
    """Unrolled for few features, array functions for wide rows."""
    width, kept = len(scaled), len(components[0])
    if width * kept > 256:
        across = F.array(*[F.array(*[F.lit(row[j]) for row in components]) for j in range(kept)])
        along = F.array(*[F.array(*[F.lit(v) for v in row]) for row in components])

        def wide(x: Column) -> Column:
            def error(z: Column) -> Column:
                rebuilt = F.transform(along, lambda row: _dot(z, row))
                gaps = F.zip_with(x, rebuilt, lambda u, v: u - v)
                return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g) / float(width)

            return bind(F.transform(across, lambda row: _dot(x, row)), error)

        return bind(F.array(*scaled), wide)

    def add(terms: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, terms)

    def narrow(row: Column) -> Column:
        codes = F.array(*[add([row[i] * components[i][j] for i in range(width)]) for j in range(kept)])

        def error(z: Column) -> Column:
            gaps = [row[i] - add([z[j] * components[i][j] for j in range(kept)]) for i in range(width)]
            return add([g * g for g in gaps]) / float(width)

        return bind(codes, error)

    return bind(F.array(*scaled), narrow)


def fit_reconstruction(
    df: DataFrame,
    features: list[str],
    *,
    percentile: float = 90.0,
    scaler: Scaler | None = None,
    components: int | None = None,
) -> Reconstruction:
    """Components, error threshold at ``percentile`` and statistics of the log error."""
    model = fit_components(df, scaler or fit_scaler(df, features), components)
    errors = cut_lineage(df.select(reconstruction_error(model).alias("e")))
    return with_threshold(model, errors, exact_percentiles(errors, "e", [percentile])[0])


def with_threshold(model: Reconstruction, errors: DataFrame, threshold: float) -> Reconstruction:
    stats = collect_stats(errors.select(log_error(F.col("e")).alias("l")), "l", threshold)
    return Reconstruction(model.scaler, model.components, threshold, stats)


def score_reconstruction(df: DataFrame, model: Reconstruction) -> DataFrame:
    """Error, log error, normalised score, prediction, label and confidence."""
    df = df.withColumn("score_ae", reconstruction_error(model)).withColumn(
        "score_ae_log", log_error(F.col("score_ae"))
    )
    df = normalise_score(df, "score_ae_log", "score_ae_normalized", model.stats)
    df = with_verdict(df, "ae", F.col("score_ae") > model.threshold, "score_ae_normalized")
    return df.withColumns(
        {
            "ae_threshold_raw": F.lit(model.threshold),
            "ae_threshold_log": F.log1p(F.greatest(F.lit(model.threshold), F.lit(0.0))),
        }
    )


def vector_columns(df: DataFrame, column: str, width: int, prefix: str = "f") -> DataFrame:
    """A fixed-width array as one double column per element."""
    return df.select(
        *[n for n in df.columns if n != column],
        *[F.get(column, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(width)],
    )
