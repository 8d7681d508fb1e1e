"""Fit, tune, select and evaluate on a labelled feature table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.config import EnsembleConfig
from flowguard.operators.ensemble import ensemble_sweep, sweep_candidates
from flowguard.operators.evaluation import best_candidate, binary_metrics, metrics_by_module, target_counts, threshold_sweep
from flowguard.operators.forest import (
    Forest, ForestConfig, anomaly_scores, calibrate, fit_forest, forest_grid, grow_forests, score_forest, stored_forests, tree_prefix,
)
from flowguard.operators.quantiles import column_percentiles, exact_percentiles
from flowguard.operators.reconstruction import (
    Reconstruction, fit_components, fit_reconstruction, reconstruction_error, score_reconstruction, with_threshold,
)
from flowguard.operators.sampling import balance, balance_strategies, cap_rows, stratified_split
from flowguard.operators.scaling import fit_scaler
from flowguard.plans.batch import ScoringModel, score_windows
from flowguard.session import cut_lineage

PERCENTILES = [80.0, 85.0, 90.0, 95.0]


@dataclass(frozen=True)
class Tuned:
    """One balance strategy with its best detectors and the metrics that chose them."""

    strategy: str
    model: ScoringModel
    percentile: float
    metrics: dict


def tune_forest(
    train: DataFrame, validation: DataFrame, target: str, key_cols: list[str], grid: list[ForestConfig] | None = None
) -> tuple[Forest, DataFrame]:
    """Metrics of every candidate and the calibrated best forest.

    Trees differ only by sample size, so one job grows the largest forest of each sample
    size; smaller forests are its first trees and are scored on the way, and every
    contamination is a percentile of the same scores.
    """
    grid = grid or forest_grid()
    sizes: dict = {}
    for c in grid:
        sizes[c.max_samples] = max(sizes.get(c.max_samples, 0), c.n_estimators)
    largest = [replace(grid[0], max_samples=s, n_estimators=n) for s, n in sizes.items()]
    nodes, rows = grow_forests(train, V.FEATURES, largest, key_cols)
    grown = dict(zip(sizes, stored_forests(nodes, V.FEATURES, largest, rows)))
    metrics, forests = None, {}
    for samples, forest in grown.items():
        same = [(i, c) for i, c in enumerate(grid) if c.max_samples == samples]
        counts = sorted({c.n_estimators for _, c in same})
        trained = cut_lineage(anomaly_scores(train.select(*V.FEATURES), forest, counts, "_s").select(*[F.col("_s")[k].alias(f"s{k}") for k in range(len(counts))]))
        wanted = {f"s{k}": sorted({100.0 * c.contamination for _, c in same if c.n_estimators == n}) for k, n in enumerate(counts)}
        cuts = {name: dict(zip(wanted[name], values)) for name, values in column_percentiles(trained, wanted).items()}
        of = {i: counts.index(c.n_estimators) for i, c in same}
        options = F.array(
            *[F.struct(F.lit(i).alias("candidate"), F.lit(of[i]).alias("trees"), F.lit(cuts[f"s{of[i]}"][100.0 * c.contamination]).alias("offset")) for i, c in same]
        )
        judged = (
            anomaly_scores(validation.select(target, *V.FEATURES), forest, counts, "_s")
            .select(target, "_s", F.inline(options))
            .withColumn("pred", (F.get("_s", F.col("trees")) < F.col("offset")).cast("int"))
        )
        part = binary_metrics(judged, target, "pred", ["candidate"])
        metrics = part if metrics is None else metrics.unionByName(part)
        forests.update({i: tree_prefix(forest, c) for i, c in same})
    metrics = cut_lineage(metrics)
    best = best_candidate(metrics, "candidate").first()
    return calibrate(train, forests[best.candidate]), metrics


def tune_reconstruction(
    train: DataFrame, validation: DataFrame, target: str, percentiles: list[float] | None = None
) -> tuple[Reconstruction, float, DataFrame]:
    """The threshold percentile that does best on validation."""
    percentiles = percentiles or PERCENTILES
    model = fit_components(train, fit_scaler(train, V.FEATURES))
    errors = cut_lineage(train.select(reconstruction_error(model).alias("e")))
    cuts = dict(zip(percentiles, exact_percentiles(errors, "e", percentiles)))
    metrics = cut_lineage(
        threshold_sweep(validation.withColumn("_e", reconstruction_error(model)), "_e", target, cuts)
    )
    best = best_candidate(metrics, "percentile").first().percentile
    return with_threshold(model, errors, cuts[best]), best, metrics


def tune_ensemble(
    validation: DataFrame, target: str, forest: Forest, reconstruction: Reconstruction, clipped: bool = True
) -> tuple[EnsembleConfig, DataFrame]:
    """The best effective weights and threshold."""
    scored = score_reconstruction(score_forest(validation, forest), reconstruction)
    candidates = sweep_candidates(clipped=clipped)
    metrics = cut_lineage(ensemble_sweep(scored, target, candidates, reconstruction.threshold))
    best = best_candidate(metrics, "candidate").first()
    return replace(candidates[best.candidate], ae_reference=reconstruction.threshold), metrics


def run_strategy(
    strategy: str, train: DataFrame, validation: DataFrame, target: str, key_cols: list[str], grid=None
) -> Tuned:
    """Tune everything on one balance of the training rows."""
    balanced = cut_lineage(balance(train, target, key_cols, strategy))
    forest, _ = tune_forest(balanced, validation, target, key_cols, grid)
    reconstruction, percentile, _ = tune_reconstruction(balanced, validation, target)
    ensemble, metrics = tune_ensemble(validation, target, forest, reconstruction)
    chosen = best_candidate(metrics, "candidate").first().asDict()
    return Tuned(strategy, ScoringModel(forest, reconstruction, ensemble), percentile, chosen)


def pick_strategy(results: list[Tuned]) -> Tuned:
    """The strategy whose ensemble does best, first on ties."""
    if not results:
        raise ValueError("no strategy was run")
    return max(
        results,
        key=lambda r: (r.metrics["recall"], r.metrics["f1_score"], -r.metrics["false_positive_rate"], r.metrics["precision"]),
    )


def train_tuned(
    df: DataFrame, target: str = "y", key_cols: list[str] | None = None, *, strategy: str = "auto",
    max_rows: int | None = None, seed: int = 42, grid: list[ForestConfig] | None = None,
) -> tuple[ScoringModel, Tuned, DataFrame]:
    """Split, tournament over balances, refit on train and validation.

    Returns the final model, the winning run and the split table.
    """
    keys = key_cols or ["row_id"]
    split = cut_lineage(stratified_split(cap_rows(df, target, keys, max_rows, seed), target, keys, seed=seed))
    part = {n: split.where(F.col("split") == n) for n in ("train", "validation", "test")}
    best = pick_strategy(
        [run_strategy(s, part["train"], part["validation"], target, keys, grid) for s in balance_strategies(strategy)]
    )
    refit = cut_lineage(balance(split.where(F.col("split") != "test"), target, keys, best.strategy, seed))
    forest = fit_forest(refit, V.FEATURES, best.model.forest.config, key_cols=keys)
    reconstruction = fit_reconstruction(refit, V.FEATURES, percentile=best.percentile)
    ensemble = replace(best.model.ensemble, ae_reference=reconstruction.threshold)
    return ScoringModel(forest, reconstruction, ensemble), best, split


def evaluate_splits(
    split: DataFrame, model: ScoringModel, target: str = "y", profiles: tuple[str, ...] = ("balanced", "conservative")
) -> DataFrame:
    """Metrics per split, profile and module."""
    parts = None
    for profile in profiles:
        scored = score_windows(split, model, profile=profile, context=False).withColumn("profile", F.lit(profile))
        metrics = metrics_by_module(scored, target, ["split", "profile"])
        parts = metrics if parts is None else parts.unionByName(metrics)
    return parts


def target_distribution(split: DataFrame, target: str = "y") -> DataFrame:
    """A19 per split."""
    return target_counts(split, target, ["split"])
