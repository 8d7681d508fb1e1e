"""Detector scores on a common scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.functions.scalar import clamp, finite, log1p_positive
from flowguard.operators.single import attach_row


@dataclass(frozen=True)
class ScoreStats:
    """Distribution of training scores."""

    minimum: float
    maximum: float
    mean: float
    std: float
    threshold: float | None = None

    @property
    def ranged(self) -> bool:
        return self.maximum > self.minimum


def clean_score(value: Column) -> Column:
    return F.coalesce(finite(value.cast("double")), F.lit(0.0))


def score_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row of min, max, mean and population deviation."""
    score = clean_score(F.col(column))
    return df.agg(
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
    )


def collect_stats(df: DataFrame, column: str, threshold: float | None = None) -> ScoreStats:
    """The one-row statistics as literals."""
    row = score_statistics(df, column).first()
    if row.score_min is None:
        return ScoreStats(0.0, 0.0, 0.0, 0.0, threshold)
    return ScoreStats(row.score_min, row.score_max, row.score_mean, row.score_std, threshold)


def _bounded(value: Column, low: Column, high: Column) -> Column:
    return clamp((value - low) / (high - low))


def _logistic(value: Column, stats: ScoreStats | None) -> Column:
    center = stats.mean if stats else 0.0
    scale = max(stats.std * 2.0, 1e-6) if stats and stats.std > 0 else 1.0
    return clamp(1.0 / (1.0 + F.exp(-(value - center) / scale)))


def normalise_score(df: DataFrame, source: str, target: str, stats: ScoreStats | None = None) -> DataFrame:
    """Score in 0..1 from stored bounds, else from the batch, else by sigmoid.

    Without stored bounds the two extremes of the batch come from an aggregate that
    is attached as a scalar; streams must pass ``stats``.
    """
    value = clean_score(F.col(source))
    if stats is not None and stats.ranged:
        return df.withColumn(target, _bounded(value, F.lit(stats.minimum), F.lit(stats.maximum)))
    extremes = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    joined = attach_row(df, extremes)
    return joined.withColumn(
        target,
        F.when(F.col("_high") > F.col("_low"), _bounded(value, F.col("_low"), F.col("_high"))).otherwise(
            _logistic(value, stats)
        ),
    ).drop("_low", "_high")


def confidence(pred: Column, normalised: Column) -> Column:
    """Confidence in the predicted class."""
    return clamp(F.when(pred == 1, normalised).otherwise(1.0 - normalised))


def with_verdict(df: DataFrame, prefix: str, pred: Column, normalised: str) -> DataFrame:
    """Prediction, label and confidence columns of one detector."""
    return df.withColumn(f"pred_{prefix}", pred.cast("int")).withColumns(
        {
            f"label_{prefix}": F.when(F.col(f"pred_{prefix}") == 1, "attack").otherwise("normal"),
            f"{prefix}_confidence": confidence(F.col(f"pred_{prefix}"), F.col(normalised)),
        }
    )


def log_error(value: Column) -> Column:
    """M07."""
    return log1p_positive(clean_score(value))


