"""Binary metrics, rankings and profile comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = [
    "precision", "recall", "f1_score", "accuracy", "specificity", "false_positive_rate", "selection_score",
]
MODULES = {
    "isolation_forest": "pred_if",
    "autoencoder": "pred_ae",
    "heuristic": "heuristic_detected_attack",
    "ensemble": "pred_ensemble",
    "decision_engine": "pred_decision_engine",
}
COMPARED = ("recall", "precision", "f1_score", "false_positive_rate", "accuracy")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, truth: str, pred: str, groups: list[str] | None = None) -> DataFrame:
    """The four counts, per group."""
    t, p = F.col(truth).cast("int") == 1, F.col(pred).cast("int") == 1
    return df.groupBy(*(groups or [])).agg(
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(t & p).alias("tp"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Metrics of confusion counts, zero where a denominator is zero."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    df = counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
            "specificity": _ratio(tn, tn + fp),
            "false_positive_rate": _ratio(fp, fp + tn),
        }
    )
    return df.withColumn(
        "selection_score",
        F.col("recall") * 0.55 + F.col("f1_score") * 0.25 + F.col("precision") * 0.10 + F.col("specificity") * 0.10,
    )


def binary_metrics(df: DataFrame, truth: str, pred: str, groups: list[str] | None = None) -> DataFrame:
    return with_metrics(confusion(df, truth, pred, groups))


def target_counts(df: DataFrame, target: str, groups: list[str] | None = None) -> DataFrame:
    """A19."""
    t = F.col(target).cast("int")
    return df.groupBy(*(groups or [])).agg(
        F.count_if(t == 0).alias("normal"), F.count_if(t == 1).alias("attack"), F.count(F.lit(1)).alias("total")
    )


def _best_first(f1_first: bool = False) -> list[Column]:
    lead = ["f1_score", "recall"] if f1_first else ["recall", "f1_score"]
    return [F.desc(lead[0]), F.desc(lead[1]), F.asc("false_positive_rate"), F.desc("precision")]


def ranked_candidates(metrics: DataFrame, order_col: str, groups: list[str] | None = None, f1_first: bool = False) -> DataFrame:
    """Candidates ranked; metric rows are few, one per candidate."""
    window = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*_best_first(f1_first), order_col)
    return metrics.withColumn("rank", F.row_number().over(window))


def best_candidate(metrics: DataFrame, order_col: str, f1_first: bool = False) -> DataFrame:
    """The first of the best."""
    return metrics.orderBy(*_best_first(f1_first), order_col).limit(1)


def module_predictions(scored: DataFrame, target: str, groups: list[str]) -> DataFrame:
    """One row per window and module."""
    rows = F.array(
        *[F.struct(F.lit(m).alias("module"), F.col(c).cast("int").alias("pred")) for m, c in MODULES.items()]
    )
    return scored.select(*groups, F.col(target).cast("int").alias("target"), F.inline(rows))


def metrics_by_module(scored: DataFrame, target: str, groups: list[str]) -> DataFrame:
    """Metrics per group and module from one pass."""
    return binary_metrics(module_predictions(scored, target, groups), "target", "pred", [*groups, "module"])


def profile_delta(metrics: DataFrame, groups: list[str], modules: tuple[str, ...] = ("ensemble", "decision_engine")) -> DataFrame:
    """Balanced minus conservative per group and module."""
    kept = metrics.where(F.col("module").isin(*modules))

    def of(profile: str, name: str) -> Column:
        return F.max(F.when(F.col("profile") == profile, F.col(name)))

    return kept.groupBy(*groups, "module").agg(
        *[
            (F.coalesce(of("balanced", n), F.lit(0.0)) - F.coalesce(of("conservative", n), F.lit(0.0))).alias(f"delta_{n}")
            for n in COMPARED
        ]
    )


def threshold_sweep(df: DataFrame, error: str, target: str, thresholds: dict[float, float]) -> DataFrame:
    """Metrics of every candidate threshold; rows are multiplied by the few candidates only."""
    options = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.lit(t).alias("threshold")) for p, t in thresholds.items()])
    judged = df.select(F.col(error).alias("e"), F.col(target).alias("target"), F.inline(options)).withColumn(
        "pred", (F.col("e") > F.col("threshold")).cast("int")
    )
    return binary_metrics(judged, "target", "pred", ["percentile", "threshold"])
