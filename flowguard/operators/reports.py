"""Nested reports and batch summaries of scored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.operators.distributions import distribution_maps, distributions, numeric_summary
from flowguard.operators.single import attach_row

# Report module -> field -> scored column.
MODULE_FIELDS = {
    "isolation_forest": {
        "pred": "pred_if", "label": "label_if", "raw_score": "score_if",
        "normalized_score": "score_if_normalized", "confidence": "if_confidence",
    },
    "autoencoder": {
        "pred": "pred_ae", "label": "label_ae", "raw_score": "score_ae", "log_score": "score_ae_log",
        "normalized_score": "score_ae_normalized", "confidence": "ae_confidence",
        "threshold_raw": "ae_threshold_raw", "threshold_log": "ae_threshold_log",
    },
    "heuristic": {
        "pred": "heuristic_detected_attack", "attack_type": "heuristic_attack_type",
        "confidence": "heuristic_confidence", "reason": "heuristic_reason",
    },
    "ensemble": {
        "pred": "pred_ensemble", "score": "ensemble_score", "threshold": "ensemble_threshold",
        "runtime_profile": "runtime_profile", "if_weight": "ensemble_if_weight", "ae_weight": "ensemble_ae_weight",
        "if_alert_score": "ensemble_if_alert_score", "agreement_score": "ensemble_agreement_score",
        "conflict_penalty": "ensemble_conflict_penalty", "ae_risk_score": "ensemble_ae_risk_score",
        "ae_risk_band": "ensemble_ae_risk_band",
    },
    "ai_support": {
        "enabled": "ai_support", "conservative": "ai_support_conservative", "type": "ai_support_type",
        "level": "ai_support_level", "reason": "ai_support_reason", "signals": "ai_support_signals",
    },
    "decision_engine": {
        "pred": "pred_decision_engine", "is_anomaly": "is_anomaly", "final_label": "final_label",
        "attack_type": "attack_type", "risk_level": "risk_level", "confidence": "confidence",
        "decision_source": "decision_source", "agreement_level": "agreement_level",
        "decision_reason": "decision_reason", "explanation": "explanation", "conflict_winner": "conflict_winner",
        "base_attack_support": "base_attack_support", "base_negative_support": "base_negative_support",
    },
}
COUNTED = [
    "pred_decision_engine", "is_anomaly", "final_label", "attack_type", "risk_level", "decision_source",
    "ai_support", "ai_support_conservative", "ai_support_type", "ai_support_level", "heuristic_attack_type",
    "pred_if", "pred_ae", "heuristic_detected_attack", "pred_ensemble", "ensemble_ae_risk_band",
]
MEASURED = [
    "score_if", "score_if_normalized", "if_confidence", "score_ae", "score_ae_log", "score_ae_normalized",
    "ae_confidence", "ae_threshold_raw", "heuristic_confidence", "ensemble_score", "ensemble_threshold", "confidence",
]


def row_reports(scored: DataFrame) -> DataFrame:
    """One nested row per window: metadata, features and a struct per module."""

    def module(fields: dict[str, str]):
        return F.struct(*[F.col(c).alias(f) for f, c in fields.items() if c in scored.columns])

    metadata = [n for n in V.WINDOW_METADATA if n in scored.columns]
    return scored.select(
        *[n for n in ("window_id",) if n in scored.columns],
        F.struct(*metadata).alias("metadata"),
        F.struct(*V.FEATURES).alias("features"),
        *[module(fields).alias(name) for name, fields in MODULE_FIELDS.items()],
    )


def live_records(
    scored: DataFrame, *, source_path: str, execution_id: str, created_at=None, remote_path: str | None = None
) -> DataFrame:
    """Rows of the live history table with nested payloads."""
    from flowguard.operators.history import window_uid

    payload = {
        name: F.struct(*[F.col(c).alias(f) for f, c in fields.items() if c in scored.columns])
        for name, fields in MODULE_FIELDS.items()
    }
    now = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    scores = ["confidence", "ensemble_score", "autoencoder_score", "isolation_score"]
    return scored.select(
        window_uid(F.lit(source_path)).alias("window_uid"),
        F.lit(execution_id).alias("execution_id"),
        now.alias("created_at"),
        F.lit("success").alias("status"),
        F.lit(source_path).alias("local_log_path"),
        F.lit(remote_path).cast("string").alias("remote_path"),
        "window_id",
        F.col("window_start").alias("window_timestamp"),
        "window_start",
        "window_end",
        "final_label", "attack_type", "risk_level", "decision_source", "decision_reason",
        *scores,
        F.struct(*V.FEATURES).alias("features"),
        F.struct(*[p.alias(n) for n, p in payload.items()]).alias("model_outputs"),
        F.struct(*[n for n in V.WINDOW_METADATA if n in scored.columns]).alias("metadata"),
    )


def inference_counts(scored: DataFrame) -> DataFrame:
    """Counts of every categorical output, long form, one scan."""
    return distributions(scored, [c for c in COUNTED if c in scored.columns])


def inference_numbers(scored: DataFrame) -> DataFrame:
    """Min, max and mean of every numeric output, one scan."""
    return numeric_summary(scored, [c for c in MEASURED if c in scored.columns])


def inference_summary(scored: DataFrame) -> DataFrame:
    """One row with a map per categorical output and a struct per numeric one."""
    counted = [c for c in COUNTED if c in scored.columns]
    maps = distribution_maps(inference_counts(scored), counted, "_counts")
    numbers = inference_numbers(scored).agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("min", "max", "mean")))).alias("numeric")
    )
    return attach_row(maps, numbers)


def scenario_summary(scored: DataFrame, lines: DataFrame | None = None, scenario: str = "scenario") -> DataFrame:
    """Per scenario its windows, distributions and an observation."""
    columns = ["is_anomaly", "final_label", "attack_type", "risk_level", "decision_source"]
    order = F.struct("window_start", "source_ip")
    cube = scored.groupBy(scenario, *columns).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    long = (
        cube.select(scenario, "n", "first", F.inline(pairs))
        .groupBy(scenario, "dimension", "value")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    of = lambda c, x: F.when(F.col("dimension") == c, x)
    mode = lambda c: F.min_by(of(c, F.col("value")), of(c, F.struct(-F.col("n"), F.col("first"))))
    summary = long.groupBy(scenario).agg(
        F.sum(of("final_label", F.col("n"))).alias("windows"),
        *[
            F.map_from_entries(F.sort_array(F.collect_list(of(c, F.struct("value", "n"))))).alias(f"{c}_counts")
            for c in columns
        ],
        *[mode(c).alias(f"dominant_{c}") for c in ("final_label", "attack_type", "risk_level")],
    )
    calm = F.col(scenario) == "normal_firewall"
    observation = (
        F.when(calm & (F.col("dominant_final_label") == "normal"), V.OBSERVATIONS["calm"])
        .when(calm, V.OBSERVATIONS["noisy"])
        .when(
            F.col("dominant_attack_type") != "normal",
            F.format_string(V.OBSERVATIONS["kept"], "dominant_attack_type", "dominant_risk_level"),
        )
        .otherwise(V.OBSERVATIONS["lost"])
    )
    summary = summary.withColumn("observation", observation)
    if lines is not None:
        parsed = lines.groupBy(scenario).agg(F.count(F.lit(1)).alias("parsed_lines"))
        summary = summary.join(parsed, scenario, "left")
    return summary
