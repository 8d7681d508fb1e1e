"""Decision rules that the generated tables do not reach."""

import pytest

from flowguard.operators.decision import decide

SCHEMA = (
    "pred_if int, score_if double, score_if_normalized double, pred_ae int, score_ae double, score_ae_normalized double, "
    "heuristic_detected_attack boolean, heuristic_attack_type string, heuristic_confidence double, "
    "ensemble_score double, pred_ensemble int, ensemble_ae_risk_band string"
)


def row(pred_if, if_norm, pred_ae, raw, ae_norm, kind, sure, ensemble, band):
    return (pred_if, 0.1, if_norm, pred_ae, raw, ae_norm, kind != "normal", kind, sure, ensemble, 0, band)


CASES = {
    "balanced": [
        (row(0, 0.5, 1, 2.0, 0.9, "normal", 0.78, 0.60, "high"), "ae_primary", "ae_high_risk", 0.92),
        (row(0, 1.0, 1, 2.0, 0.9, "normal", 0.78, 0.60, "high"), "full_agreement", "ae_high_risk", 0.98),
        (row(0, 0.5, 1, 2.0, 0.9, "brute_force", 0.70, 0.10, "high"), "contextual_agreement", "ae_high_risk", 0.94),
        (row(0, 0.5, 1, 1.0, 0.6, "normal", 0.78, 0.50, "medium"), "contextual_agreement", "ae_medium_risk", 0.64),
        (row(0, 1.0, 1, 1.0, 0.6, "port_scan", 0.70, 0.10, "medium"), "contextual_agreement", "ae_contextual_band", 0.656),
        (row(1, 0.5, 0, 0.01, 0.1, "normal", 0.78, 0.70, "low"), "contextual_support", "ensemble_support", 0.728),
        (row(0, 0.1, 0, 0.01, 0.1, "normal", 0.78, 0.70, "low"), "full_agreement_negative", "safe_negative", 0.95),
    ],
    "conservative": [
        (row(0, 0.5, 1, 2.0, 0.9, "normal", 0.78, 0.60, "high"), "ae_primary", "ae_high_risk", 0.915),
        (row(0, 0.5, 1, 2.0, 0.9, "brute_force", 0.70, 0.60, "high"), "suppressed_by_context", "suppressed_by_context", None),
        (row(0, 0.5, 1, 1.0, 0.6, "normal", 0.78, 0.50, "medium"), "ae_primary", "ae_medium_risk", 0.615),
        (row(0, 0.5, 1, 1.0, 0.6, "unknown_anomaly", 0.60, 0.50, "medium"), "contextual_agreement", "ae_contextual_band", 0.63),
        (row(0, 0.5, 1, 1.0, 0.6, "ssh_suspicious", 0.60, 0.50, "medium"), "suppressed_by_context", "suppressed_by_context", None),
    ],
}


@pytest.mark.parametrize("profile", CASES)
def test_rules_in_order(spark, profile):
    df = spark.createDataFrame([c[0] for c in CASES[profile]], SCHEMA).coalesce(1)
    rows = decide(df, profile=profile, ae_reference=1.0).collect()
    for got, (_, agreement, source, confidence) in zip(rows, CASES[profile]):
        assert (got.agreement_level, got.decision_source) == (agreement, source)
        assert got.is_anomaly == (source not in ("safe_negative", "suppressed_by_context"))
        if confidence is not None:
            assert got.confidence == pytest.approx(confidence)
