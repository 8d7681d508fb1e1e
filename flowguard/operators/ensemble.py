"""Support score of the two detectors and the AI-support flags."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.config import EnsembleConfig, ensemble_profile
from flowguard.functions.scalar import clamp
from flowguard.operators.evaluation import binary_metrics
from flowguard.operators.scores import clean_score, log_error
from flowguard.operators.single import attach_row


def band_thresholds(reference: Column, config) -> tuple[Column, Column, Column]:
    low = F.greatest(reference * config.low_ratio, F.lit(1e-6))
    medium = F.greatest(reference * config.medium_ratio, low + 1e-6)
    high = F.greatest(reference * config.high_ratio, medium + 1e-6)
    return low, medium, high


def risk_band(raw: Column, normalised: Column, pred: Column, reference: Column, config) -> Column:
    """low / medium / high zone of a reconstruction error."""
    _, medium, high = band_thresholds(reference, config)
    ratio = raw / reference
    hit = pred == 1
    return (
        F.when(hit & ((normalised >= config.strong) | (ratio >= 1.50) | (raw >= high)), "high")
        .when(hit | ((normalised >= config.moderate) & (ratio >= 0.75)) | (raw >= medium), "medium")
        .otherwise("low")
    )


def ensemble_support(
    df: DataFrame,
    config: EnsembleConfig | None = None,
    *,
    profile: str | None = None,
    ae_reference: float | str | None = None,
) -> DataFrame:
    """Support score and its parts.

    Reads ``pred_if``, ``score_if``, ``score_if_normalized``, ``pred_ae``,
    ``score_ae`` and ``score_ae_normalized``. ``ae_reference`` is a number or a column.
    """
    return support_columns(df, ensemble_profile(config, profile), ae_reference)


def support_columns(df: DataFrame, cfg: EnsembleConfig, ae_reference: float | str | None) -> DataFrame:
    """M11 under resolved parameters."""
    if_weight, ae_weight = cfg.weights()
    reference = cfg.ae_reference if cfg.ae_reference is not None else ae_reference
    if reference is None:
        raise ValueError("an ensemble needs the reference threshold of the reconstruction error")
    reference = F.col(reference) if isinstance(reference, str) else F.lit(float(reference))
    reference = F.greatest(reference.cast("double"), F.lit(1e-6))
    raw = F.greatest(F.col("score_ae"), F.lit(0.0))
    ae_norm, if_norm = clamp(F.col("score_ae_normalized")), clamp(F.col("score_if_normalized"))
    ae_hit, if_hit = F.col("pred_ae") == 1, F.col("pred_if") == 1
    ratio = F.least(raw / reference, F.lit(1.0))
    alert = 1.0 / (1.0 + F.exp(-((F.col("score_if") - cfg.alert_center) / max(cfg.alert_scale, 1e-6))))
    df = df.withColumns(
        {
            "ensemble_ae_risk_band": risk_band(raw, ae_norm, F.col("pred_ae"), reference, cfg),
            "ensemble_ae_risk_score": clamp(
                F.when(ae_hit, F.greatest(ae_norm, ratio)).otherwise(F.greatest(ae_norm * 0.25, ratio * 0.15))
            ),
            "ensemble_if_alert_score": clamp(
                F.when(if_hit, F.greatest(alert, F.lit(cfg.alert_floor), if_norm)).otherwise(
                    F.least(alert, if_norm) * 0.25
                )
            ),
            "ensemble_ae_reference": reference,
        }
    )
    band = F.col("ensemble_ae_risk_band")
    risk, alerted = F.col("ensemble_ae_risk_score"), F.col("ensemble_if_alert_score")
    df = df.withColumns(
        {
            "ensemble_agreement_score": F.when(if_hit & ae_hit, clamp(F.least(risk, alerted))).otherwise(0.0),
            "ensemble_conflict_penalty": F.when(if_hit & (band == "medium"), cfg.conflict * 0.60)
            .when(if_hit & (band == "low"), cfg.conflict)
            .otherwise(0.0),
            "ensemble_band_boost": F.when(band == "medium", cfg.medium_boost)
            .when(band == "high", cfg.high_boost)
            .otherwise(0.0),
            "ensemble_if_stability_score": clamp(1.0 - alerted),
        }
    )
    support = clamp(
        risk * ae_weight
        + alerted * if_weight
        + F.col("ensemble_agreement_score") * cfg.agreement
        + F.col("ensemble_band_boost")
        - F.col("ensemble_conflict_penalty")
    )
    threshold = cfg.support_threshold()
    low_promoted = (alerted >= cfg.strong) if cfg.profile == "balanced" else F.lit(False)
    df = df.withColumn("ensemble_score", support)
    return df.withColumns(
        {
            "pred_ensemble": ((F.col("ensemble_score") >= threshold) & ((band != "low") | low_promoted)).cast("int"),
            "ensemble_threshold": F.lit(threshold),
            "ensemble_if_weight": F.lit(if_weight),
            "ensemble_ae_weight": F.lit(ae_weight),
            "runtime_profile": F.lit(cfg.profile),
        }
    )


@dataclass(frozen=True)
class SweptConfig(EnsembleConfig):
    """Weights and threshold read from a ``_candidate`` struct instead of fixed."""

    def weights(self) -> tuple[Column, Column]:
        return F.col("_candidate.if_weight"), F.col("_candidate.ae_weight")

    def support_threshold(self) -> Column:
        return F.col("_candidate.threshold")


# Candidate weights (forest, reconstruction) and thresholds.
WEIGHT_OPTIONS = ((0.10, 0.90), (0.12, 0.88), (0.15, 0.85), (0.20, 0.80))
THRESHOLD_OPTIONS = (0.52, 0.55, 0.58, 0.60)


def sweep_candidates(
    weights: tuple = WEIGHT_OPTIONS, thresholds: tuple = THRESHOLD_OPTIONS, profile: str = "balanced", clipped: bool = True
) -> list[EnsembleConfig]:
    """Candidates with different effective parameters.

    A profile clips weights and thresholds, which makes most of the grid equal;
    ``clipped=False`` keeps the profile out of the two swept parameters.
    """
    seen, kept = set(), []
    for (iforest, ae), threshold in ((w, t) for w in weights for t in thresholds):
        config = EnsembleConfig(if_weight=iforest, ae_weight=ae, threshold=threshold)
        resolved = ensemble_profile(config, profile)
        if not clipped:
            resolved = replace(resolved, if_weight=iforest, ae_weight=ae, threshold=threshold)
        effective = (*resolved.weights(), resolved.support_threshold())
        if effective not in seen:
            seen.add(effective)
            kept.append(resolved)
    return kept


def ensemble_sweep(df: DataFrame, target: str, candidates: list[EnsembleConfig], ae_reference: float | str) -> DataFrame:
    """Metrics of every candidate from one pass over the scored rows."""
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("candidate"),
                F.lit(c.weights()[0]).alias("if_weight"),
                F.lit(c.weights()[1]).alias("ae_weight"),
                F.lit(c.support_threshold()).alias("threshold"),
            )
            for i, c in enumerate(candidates)
        ]
    )
    base = candidates[0]
    swept = SweptConfig(**{f.name: getattr(base, f.name) for f in fields(EnsembleConfig)})
    judged = support_columns(df.withColumn("_candidate", F.explode(options)), swept, ae_reference)
    metrics = binary_metrics(judged, target, "pred_ensemble", ["_candidate"])
    return metrics.select("_candidate.*", *[c for c in metrics.columns if c != "_candidate"])


def weighted_ensemble(df: DataFrame, config: EnsembleConfig) -> DataFrame:
    """Weighted mean of both scores, each scaled to 0..1.

    Forest scores that never exceed zero are flipped first. Extremes come from
    ``config`` when stored, else from one aggregate attached as a scalar.
    """
    iforest, error = clean_score(F.col("score_if")), log_error(F.col("score_ae"))
    extremes = df.agg(
        F.min(iforest).alias("_if_low"), F.max(iforest).alias("_if_high"),
        F.min(error).alias("_ae_low"), F.max(error).alias("_ae_high"),
    )
    flipped = F.col("_if_high") <= 0
    oriented = F.when(flipped, -iforest).otherwise(iforest)
    batch = {
        "if": (F.when(flipped, -F.col("_if_high")).otherwise(F.col("_if_low")),
               F.when(flipped, -F.col("_if_low")).otherwise(F.col("_if_high"))),
        "ae": (F.col("_ae_low"), F.col("_ae_high")),
    }
    stored = {
        "if": (config.if_min, config.if_max),
        "ae": tuple(None if x is None else log_error(F.lit(x)) for x in (config.ae_min, config.ae_max)),
    }
    spans = {"if": (config.if_min, config.if_max), "ae": (config.ae_min, config.ae_max)}

    def scaled(name: str, value: Column) -> Column:
        low, high = spans[name]
        if low is not None and high is not None and high > low:
            bottom, top = (F.lit(x) if isinstance(x, float) else x for x in stored[name])
        else:
            bottom, top = batch[name]
        return F.when(top > bottom, clamp((value - bottom) / (top - bottom))).otherwise(0.0)

    if_weight, ae_weight = config.weights()
    return (
        attach_row(df, extremes)
        .withColumns({"if_score_scaled": scaled("if", oriented), "ae_score_scaled": scaled("ae", error)})
        .withColumn(
            "support_score", clamp(F.col("ae_score_scaled") * ae_weight + F.col("if_score_scaled") * if_weight)
        )
        .withColumn("support_pred", (F.col("support_score") >= config.support_threshold()).cast("int"))
        .drop("_if_low", "_if_high", "_ae_low", "_ae_high")
    )


def ai_support(df: DataFrame) -> DataFrame:
    """Auxiliary flags; they never change the decision."""
    ensemble = F.col("ensemble_score") >= V.AI_SUPPORT_ENSEMBLE
    error = F.col("score_ae") >= V.AI_SUPPORT_AE_RAW
    forest = F.col("score_if_normalized") >= V.AI_SUPPORT_IF_NORMALIZED
    strong = ensemble & error & forest
    reasons = V.AI_SUPPORT_REASONS

    def choose(high: str, middle: str, none: str) -> Column:
        return F.when(strong, high).when(ensemble, middle).otherwise(none)

    signals = F.struct(
        F.lit(V.AI_SUPPORT_VERSION).alias("criteria_version"),
        F.struct(
            F.col("ensemble_score").alias("score"), F.lit(V.AI_SUPPORT_ENSEMBLE).alias("threshold"), ensemble.alias("passed")
        ).alias("ensemble"),
        F.struct(
            F.col("score_ae").alias("raw_score"), F.lit(V.AI_SUPPORT_AE_RAW).alias("threshold_raw"), error.alias("passed")
        ).alias("autoencoder"),
        F.struct(
            F.col("score_if_normalized").alias("normalized_score"),
            F.lit(V.AI_SUPPORT_IF_NORMALIZED).alias("threshold_normalized"),
            forest.alias("passed"),
        ).alias("isolation_forest"),
        strong.alias("conservative_passed"),
    )
    return df.withColumns(
        {
            "ai_support": ensemble,
            "ai_support_conservative": strong,
            "ai_support_type": choose("ensemble_autoencoder_if", "ensemble_score", "none"),
            "ai_support_level": choose("strong", "moderate", "none"),
            "ai_support_reason": choose(reasons["strong"], reasons["moderate"], reasons["none"]),
            "ai_support_signals": signals,
        }
    )
