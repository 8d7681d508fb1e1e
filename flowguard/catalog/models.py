"""Scoring queries under a fixed model, whose every number SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.catalog import tables
from flowguard.catalog.rules import REASON_SQL, SUPPORT_SQL, _decision_sql
from flowguard.catalog.tables import FW
from flowguard.catalog.windows import MODES_SQL, RULES, fw_windows
from flowguard.functions.features import resolve_base_features, with_features
from flowguard.operators.forest import NODES, Forest, ForestConfig, average_path, score_forest
from flowguard.operators.reconstruction import Reconstruction, score_reconstruction
from flowguard.operators.reports import COUNTED, MEASURED, inference_counts, inference_numbers, row_reports
from flowguard.operators.scaling import Scaler
from flowguard.operators.scores import ScoreStats
from flowguard.plans.batch import ScoringModel, score_records, score_windows
from flowguard.session import ensure_checkpoint_dir
from flowguard.sources.sinks import load_model, save_model

# Fixed values: (tree, node, feature, threshold, path); children of node i are 2i + 1 and 2i + 2.
TREES = (
    (0, 0, 0, 9.5, 0.0), (0, 1, 3, 75.0, 0.0), (0, 2, 4, 5.5, 0.0), (0, 3, -1, 0.0, 3.25), (0, 4, 1, 300.0, 0.0),
    (0, 5, -1, 0.0, 4.0), (0, 6, -1, 0.0, 2.5), (0, 9, -1, 0.0, 5.5), (0, 10, -1, 0.0, 6.75),
    (1, 0, 6, 92.0, 0.0), (1, 1, 12, 1.5, 0.0), (1, 2, -1, 0.0, 2.0), (1, 3, -1, 0.0, 4.5), (1, 4, 8, 2.25, 0.0),
    (1, 9, -1, 0.0, 6.0), (1, 10, -1, 0.0, 3.5),
    (2, 0, 9, 6.5, 0.0), (2, 1, -1, 0.0, 5.0), (2, 2, 2, 14.0, 0.0), (2, 5, -1, 0.0, 6.25), (2, 6, -1, 0.0, 1.5),
)
ROWS_PER_TREE, OFFSET = 64, -0.69
FOREST_STATS = ScoreStats(-0.12, 0.14, 0.01, 0.05)
CENTERS = (8.0, 700.0, 8.0, 85.0, 4.0, 85.0, 85.0, 1.0, 2.0, 6.0, 2.0, 4.0, 1.5)
SCALES = (4.0, 400.0, 4.0, 20.0, 2.0, 20.0, 20.0, 1.0, 0.5, 1.0, 0.5, 0.5, 0.5)
COMPONENTS = tuple((round(0.05 * (i % 5 + 1), 2), round(0.1 * (i % 3 - 1), 2)) for i in range(13))
ERROR_STATS, ERROR_THRESHOLD = ScoreStats(0.0, 2.0, 0.5, 0.4), 1.0


def fixed_forest(spark: SparkSession) -> Forest:
    return Forest(ForestConfig(n_estimators=3), tuple(V.FEATURES), ROWS_PER_TREE, spark.createDataFrame(list(TREES), NODES), OFFSET, FOREST_STATS)


def fixed_reconstruction() -> Reconstruction:
    return Reconstruction(Scaler("standard", tuple(V.FEATURES), CENTERS, SCALES), COMPONENTS, ERROR_THRESHOLD, ERROR_STATS)


def fixed_model(spark: SparkSession) -> ScoringModel:
    return ScoringModel(fixed_forest(spark), fixed_reconstruction())


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, 6) if kinds[c] == "double" else F.col(c)).alias(c) for c in columns])


FOREST_OUT = ["window_id", "score_if", "score_if_normalized", "pred_if", "label_if", "if_confidence"]
ERROR_OUT = ["window_id", "score_ae", "score_ae_log", "score_ae_normalized", "pred_ae", "label_ae", "ae_confidence", "ae_threshold_raw"]
SCORED_OUT = [
    "window_id", "score_if", "score_ae", "heuristic_attack_type", "heuristic_reason", "ensemble_ae_risk_band", "ensemble_score",
    "pred_ensemble", "is_anomaly", "final_label", "attack_type", "risk_level", "confidence", "decision_source", "agreement_level",
    "conflict_winner", "ai_support_level", "ai_support_reason",
]


def forest_scores(spark, folder):
    """A fixed node table over all windows."""
    return rounded(score_forest(fw_windows(spark, folder), fixed_forest(spark)), FOREST_OUT)


def recon_scores(spark, folder):
    """Fixed components over all windows."""
    return rounded(score_reconstruction(fw_windows(spark, folder), fixed_reconstruction()), ERROR_OUT)


def _scored(spark: SparkSession, folder: str, profile: str = "balanced") -> DataFrame:
    return score_windows(fw_windows(spark, folder), fixed_model(spark), profile=profile)


def scored_windows(spark, folder):
    """Detectors, rules, context, ensemble, decision and AI support."""
    return rounded(_scored(spark, folder), SCORED_OUT)


def scored_conservative(spark, folder):
    return rounded(_scored(spark, folder, "conservative"), SCORED_OUT)


def scored_records(spark, folder):
    """structured records of the five base values, without rule evidence."""
    w = fw_windows(spark, folder).select("window_id", *V.BASE_FEATURES)
    return rounded(score_records(w, fixed_model(spark)), ["window_id", "score_if", "score_ae"])


def record_features(spark, folder):
    """base and derived features of records whose values may be missing."""
    odd = F.col("event_id") % 5 == 0
    raw = tables.fw(spark, folder).select(
        "event_id", F.lit(1.0).alias("connections"), F.when(~odd, F.col("bytes")).cast("double").alias("bytes"), F.lit(1.0).alias("packets"),
        F.when(~odd, F.col("bytes")).cast("double").alias("packet_size"), F.lit(1.0).alias("ports"),
    )
    return rounded(with_features(resolve_base_features(raw)), ["event_id", "bytes", "bytes_per_packet", "packets_per_connection", "log1p_bytes", "log1p_ports"])


def window_reports(spark, folder):
    """Fields of every part of the nested report."""
    r = row_reports(_scored(spark, folder))
    return r.select(
        "window_id", F.col("metadata.source_ip").alias("source_ip"), F.col("metadata.event_count").alias("event_count"),
        F.round("features.log1p_bytes", 6).alias("log1p_bytes"), F.col("isolation_forest.label").alias("forest_label"),
        F.round("isolation_forest.confidence", 6).alias("forest_confidence"), F.round("autoencoder.log_score", 6).alias("log_error"),
        F.col("autoencoder.pred").alias("error_pred"), F.col("heuristic.attack_type").alias("rule_family"), F.col("heuristic.reason").alias("rule_reason"),
        F.round("ensemble.score", 6).alias("ensemble_score"), F.col("ensemble.ae_risk_band").alias("risk_band"), F.col("ai_support.type").alias("support_type"),
        F.col("decision_engine.final_label").alias("final_label"), F.round("decision_engine.confidence", 6).alias("confidence"),
    )


def inference_report_counts(spark, folder):
    """A15."""
    return inference_counts(_scored(spark, folder))


def inference_report_numbers(spark, folder):
    """A15."""
    n = inference_numbers(_scored(spark, folder))
    return n.select("column", *[F.round(c, 5).alias(c) for c in ("min", "max", "mean")])


def model_round_trip(spark, folder):
    """Scores under a model that was stored and read back."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models"
    save_model(spark, fixed_model(spark), place, "fixed")
    model = load_model(spark, place, "fixed")
    scored = score_reconstruction(score_forest(fw_windows(spark, folder), model.forest), model.reconstruction)
    return rounded(scored, ["window_id", "score_if", "pred_if", "score_ae", "pred_ae"])


QUERIES = {
    f.__name__: f
    for f in (
        forest_scores, recon_scores, scored_windows, scored_conservative, scored_records, record_features, window_reports,
        inference_report_counts, inference_report_numbers, model_round_trip,
    )
}


def _tree_sql(tree: int, node: int = 0) -> str:
    _, _, feature, threshold, path = next(t for t in TREES if t[:2] == (tree, node))
    if feature < 0:
        return f"CAST({path} AS DOUBLE)"
    return f"CASE WHEN {V.FEATURES[feature]} <= {threshold} THEN {_tree_sql(tree, 2 * node + 1)} ELSE {_tree_sql(tree, 2 * node + 2)} END"


def _normalised(value: str, stats: ScoreStats) -> str:
    return f"greatest(0, least(1, ({value} - ({stats.minimum})) / ({stats.maximum - stats.minimum})))"


_LOGS = ", ".join(f"ln(1 + {n}) AS log1p_{n}" for n in V.BASE_FEATURES)
_SCALED = ", ".join(f"({n} - {c}) / {s} AS x{i}" for i, (n, c, s) in enumerate(zip(V.FEATURES, CENTERS, SCALES)))
_CODES = ", ".join(" + ".join(f"x{i} * ({row[j]})" for i, row in enumerate(COMPONENTS)) + f" AS z{j}" for j in range(2))
_GAPS = " + ".join(f"power(x{i} - (z0 * ({a}) + z1 * ({b})), 2)" for i, (a, b) in enumerate(COMPONENTS))


def _chain(source: str) -> str:
    """CTEs from a window table ``w0`` to ``m2``: both detectors of the fixed model."""
    return f"""m0 AS (SELECT *, {_LOGS} FROM {source}), m1 AS (SELECT *, {_SCALED},
 {OFFSET} + power(2, -(({' + '.join(_tree_sql(t) for t in range(3))}) / 3) / {average_path(ROWS_PER_TREE)}) AS score_if FROM m0),
m1b AS (SELECT *, {_CODES} FROM m1),
m1c AS (SELECT *, ({_GAPS}) / 13 AS score_ae FROM m1b),
m1d AS (SELECT *, ln(1 + score_ae) AS score_ae_log, {_normalised('score_if', FOREST_STATS)} AS score_if_normalized,
  CASE WHEN score_if > 0 THEN 1 ELSE 0 END AS pred_if, {_normalised('ln(1 + score_ae)', ERROR_STATS)} AS score_ae_normalized,
  CASE WHEN score_ae > {ERROR_THRESHOLD} THEN 1 ELSE 0 END AS pred_ae FROM m1c),
m2 AS (SELECT *, CASE pred_if WHEN 1 THEN 'attack' ELSE 'normal' END AS label_if, CASE pred_ae WHEN 1 THEN 'attack' ELSE 'normal' END AS label_ae,
  CASE pred_if WHEN 1 THEN score_if_normalized ELSE 1 - score_if_normalized END AS if_confidence,
  CASE pred_ae WHEN 1 THEN score_ae_normalized ELSE 1 - score_ae_normalized END AS ae_confidence FROM m1d)"""


def _rounded_sql(columns: list[str], exact: set[str], alias: dict[str, str] | None = None) -> str:
    alias = alias or {}
    return ", ".join(f"{alias.get(c, c)} AS {c}" if c in exact else f"round({alias.get(c, c)}, 6) AS {c}" for c in columns)


_W0 = f"w AS ({MODES_SQL})"
_S = f"""{_W0}, {RULES.strip()},
{_chain('verdict')},
s AS (SELECT *, window_id AS id, heuristic_attack_type AS kind, heuristic_confidence AS rc FROM m2)"""


def _final(profile: str) -> str:
    """CTEs up to ``fin``, one row per window with every output."""
    decision = _decision_sql(profile, _S)
    head, tail = decision.rsplit("SELECT id, atk AS is_anomaly", 1)
    whole = f"{head}, fin0 AS (SELECT d6.*, atk AS is_anomaly{tail}), "
    return whole + f"""fin AS (SELECT *, {REASON_SQL} AS heuristic_reason, ens >= 0.05 AS en, ens >= 0.05 AND score_ae >= 1.0 AND score_if_normalized >= 0.82 AS st FROM fin0),
out AS (SELECT *, band AS ensemble_ae_risk_band, ens AS ensemble_score, ens_pred AS pred_ensemble, CASE WHEN is_anomaly THEN 1 ELSE 0 END AS pred_decision_engine,
 kind <> 'normal' AS heuristic_detected_attack, en AS ai_support, st AS ai_support_conservative,
 CASE WHEN st THEN 'ensemble_autoencoder_if' WHEN en THEN 'ensemble_score' ELSE 'none' END AS ai_support_type,
 CASE WHEN st THEN 'strong' WHEN en THEN 'moderate' ELSE 'none' END AS ai_support_level, {SUPPORT_SQL} AS ai_support_reason FROM fin)"""


_EXACT = {
    "window_id", "pred_if", "label_if", "pred_ae", "label_ae", "heuristic_attack_type", "heuristic_reason", "ensemble_ae_risk_band", "pred_ensemble",
    "is_anomaly", "final_label", "attack_type", "risk_level", "decision_source", "agreement_level", "conflict_winner", "ai_support_level", "ai_support_reason",
}
_NUMBERS = {
    "ae_threshold_raw": f"CAST({ERROR_THRESHOLD} AS DOUBLE)", "confidence": "conf",
}


def _scored_sql(profile: str) -> str:
    return f"{_final(profile)} SELECT {_rounded_sql(SCORED_OUT, _EXACT)} FROM out"


def _threshold(profile: str) -> float:
    from flowguard.config import ensemble_profile

    return ensemble_profile(profile=profile).support_threshold()


ORACLES = {
    "forest_scores": f"WITH {_W0}, {_chain('w')} SELECT {_rounded_sql(FOREST_OUT, _EXACT)} FROM m2",
    "recon_scores": f"WITH {_W0}, {_chain('w')} SELECT {_rounded_sql(ERROR_OUT, _EXACT, _NUMBERS)} FROM m2",
    "model_round_trip": f"WITH {_W0}, {_chain('w')} SELECT window_id, round(score_if, 6) AS score_if, pred_if, round(score_ae, 6) AS score_ae, pred_ae FROM m2",
    "scored_records": f"WITH {_W0}, {_chain('w')} SELECT window_id, round(score_if, 6) AS score_if, round(score_ae, 6) AS score_ae FROM m2",
    "record_features": f"""SELECT event_id, b AS bytes, b AS bytes_per_packet, CAST(1 AS DOUBLE) AS packets_per_connection, round(ln(1 + b), 6) AS log1p_bytes,
 round(ln(2), 6) AS log1p_ports FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(bytes AS DOUBLE) END AS b FROM ({FW}))""",
    "scored_windows": _scored_sql("balanced"),
    "scored_conservative": _scored_sql("conservative"),
    "window_reports": f"""{_final('balanced')} SELECT window_id, source_ip, event_count, round(log1p_bytes, 6) AS log1p_bytes, label_if AS forest_label,
 round(if_confidence, 6) AS forest_confidence, round(score_ae_log, 6) AS log_error, pred_ae AS error_pred, kind AS rule_family, heuristic_reason AS rule_reason,
 round(ens, 6) AS ensemble_score, band AS risk_band, ai_support_type AS support_type, final_label, round(conf, 6) AS confidence FROM out""",
    "inference_report_counts": f"{_final('balanced')} " + " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, coalesce(nullif(CAST({c} AS VARCHAR), ''), 'unknown') AS value, count(*) AS n FROM out GROUP BY 2" for c in COUNTED
    ),
    "inference_report_numbers": f"{_final('balanced')} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(min({e}), 5) AS min, round(max({e}), 5) AS max, round(avg({e}), 5) AS mean FROM out"
        for c in MEASURED
        for e in [{**_NUMBERS, "ensemble_threshold": f"CAST({_threshold('balanced')} AS DOUBLE)"}.get(c, c)]
    ),
}
