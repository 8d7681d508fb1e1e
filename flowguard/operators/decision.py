"""Final verdict per window: an ordered table of rules over derived signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.config import DecisionConfig, decision_profile
from flowguard.functions.scalar import clamp
from flowguard.operators.ensemble import risk_band


@dataclass(frozen=True)
class Outcome:
    """What a matching rule decides."""

    when: Column
    agreement: Column | str
    source: Column | str
    reason: Column | str
    attack: bool = True


def attack_family(value: Column) -> Column:
    """Standard name of an attack type; unknown names become unknown_anomaly."""
    name = F.lower(F.trim(F.coalesce(value, F.lit("normal"))))
    for alias, target in V.ATTACK_ALIASES.items():
        name = F.when(F.lower(F.trim(F.coalesce(value, F.lit("normal")))) == alias, target).otherwise(name)
    return F.when(name.isin(V.ATTACK_TYPES), name).otherwise("unknown_anomaly")


def _s(name: str) -> Column:
    return F.col(f"_d_{name}")


def _context_score(cfg: DecisionConfig) -> tuple[Column, Column]:
    """(label, score) that the behaviour rules add to the decision."""
    kind, conf = _s("family"), _s("rule_confidence")
    supportive = _s("rule_pred") & kind.isin(V.SUPPORTIVE_TYPES)
    family = _s("rule_pred") & kind.isin(V.CONTEXTUAL_TYPES)
    boost = cfg.supportive * F.when(kind == "ddos", 0.65).otherwise(1.0)
    if cfg.profile == "conservative":
        name = "suppressive"
        penalty = F.when(kind == "port_scan", cfg.suppressive).otherwise(cfg.suppressive * 0.85)
        score = -clamp(F.greatest(conf, F.lit(0.70)) * penalty)
    else:
        name = "contextual"
        gain = F.when(kind == "brute_force", cfg.contextual * 0.85).otherwise(cfg.contextual)
        score = clamp(F.greatest(conf, F.lit(0.45)) * gain)
    label = F.when(supportive, "supportive").when(family, name).otherwise("neutral")
    return label, F.when(supportive, clamp(conf * boost)).when(family, score).otherwise(0.0)


def _detector_signal(pred: Column, normalised: Column, floor: float, quiet: Column) -> Column:
    return clamp(F.when(pred == 1, F.greatest(normalised, F.lit(floor))).otherwise(quiet))


def _rule_signal() -> Column:
    """Evidence of the behaviour rules by family: (factor, floor)."""
    # Factor and floor per family.
    table = {
        "syn_flood": (0.92, 0.65), "ddos": (0.92, 0.65), "port_scan": (0.88, 0.60),
        "brute_force": (0.84, 0.56), "ssh_suspicious": (0.78, 0.45),
    }
    conf, kind = _s("rule_confidence"), _s("family")
    signal = conf * 0.70
    for name, (factor, floor) in table.items():
        signal = F.when(kind == name, F.greatest(conf * factor, F.lit(floor))).otherwise(signal)
    return F.when(_s("rule_pred"), clamp(signal)).otherwise(0.0)


def _normalised(df: DataFrame, detector: str) -> tuple[Column, Column]:
    """(score, confidence) of a detector; either is derived from the other when absent."""
    pred = F.col(f"pred_{detector}")
    nothing = F.lit(None).cast("double")
    score = F.col(f"score_{detector}_normalized") if f"score_{detector}_normalized" in df.columns else nothing
    conf = F.col(f"{detector}_confidence") if f"{detector}_confidence" in df.columns else nothing
    conf = F.when(conf.isNotNull(), clamp(conf))
    implied = F.when(conf.isNull(), F.when(pred == 1, 1.0).otherwise(0.0)).otherwise(
        F.when(pred == 1, conf).otherwise(1.0 - conf)
    )
    norm = F.coalesce(F.when(score.isNotNull(), clamp(score)), implied)
    return norm, F.coalesce(conf, clamp(F.when(pred == 1, norm).otherwise(1.0 - norm)))


def _signals(df: DataFrame, cfg: DecisionConfig, reference: Column) -> DataFrame:
    if_norm, if_conf = _normalised(df, "if")
    ae_norm, ae_conf = _normalised(df, "ae")
    has_ensemble = "ensemble_score" in df.columns
    ensemble = F.col("ensemble_score") if has_ensemble else F.lit(None).cast("double")
    df = df.withColumns(
        {
            "_d_if_pred": F.coalesce((F.col("pred_if") == 1).cast("int"), F.lit(0)),
            "_d_ae_pred": F.coalesce((F.col("pred_ae") == 1).cast("int"), F.lit(0)),
            "_d_rule_pred": F.coalesce(F.col("heuristic_detected_attack").cast("boolean"), F.lit(False)),
            "_d_family": attack_family(F.col("heuristic_attack_type")),
            "_d_rule_confidence": clamp(F.coalesce(F.col("heuristic_confidence"), F.lit(0.0))),
            "_d_if_norm": if_norm,
            "_d_ae_norm": ae_norm,
            "_d_if_confidence": if_conf,
            "_d_ae_confidence": ae_conf,
            "_d_ae_raw": F.greatest(F.coalesce(F.col("score_ae"), F.lit(0.0)), F.lit(0.0)),
            "_d_reference": F.greatest(F.coalesce(reference.cast("double"), F.lit(0.0)), F.lit(1e-6)),
            "_d_ensemble": F.when(ensemble.isNotNull(), clamp(ensemble)),
            "_d_ensemble_pred": F.coalesce((F.col("pred_ensemble") == 1), F.lit(False))
            if "pred_ensemble" in df.columns
            else F.lit(False),
        }
    )
    label, score = _context_score(cfg)
    own = risk_band(_s("ae_raw"), _s("ae_norm"), _s("ae_pred"), _s("reference"), cfg)
    given = (
        F.lower(F.trim(F.coalesce("ensemble_ae_risk_band", F.lit(""))))
        if "ensemble_ae_risk_band" in df.columns
        else F.lit("")
    )
    df = df.withColumns(
        {
            "_d_label": label,
            "_d_context": score,
            "_d_own_band": own,
            "_d_given_band": given,
            "_d_if_signal": _detector_signal(
                _s("if_pred"), _s("if_norm"), 0.55, F.greatest(_s("if_norm") - 0.85, F.lit(0.0)) * 1.50
            ),
            "_d_ae_signal": _detector_signal(_s("ae_pred"), _s("ae_norm"), 0.60, _s("ae_norm") * 0.25),
            "_d_rule_signal": _rule_signal(),
        }
    )
    weights = [max(x, 0.0) for x in (cfg.if_weight, cfg.ae_weight, cfg.heuristic_weight)]
    if_weight, ae_weight = weights[0] / sum(weights), weights[1] / sum(weights)
    blend = clamp(_s("ae_signal") * ae_weight + _s("if_signal") * if_weight)
    raised = (_s("ae_pred") == 0) & (_s("own_band") == "low") & _s("given_band").isin("medium", "high")
    return df.withColumns(
        {
            "_d_support": clamp(F.coalesce(_s("ensemble"), blend) + _s("context")),
            "_d_band": F.when(_s("given_band").isin("low", "medium", "high") & ~raised, _s("given_band")).otherwise(
                _s("own_band")
            ),
        }
    )


def _signature(cfg: DecisionConfig) -> list[Outcome]:
    """Very clear behaviour patterns win over everything else."""
    balanced = cfg.profile == "balanced"
    # Least confidence per family (balanced, conservative).
    least = {
        "signature_flood": (["syn_flood", "ddos"], 0.84, 0.90),
        "signature_port_scan": (["port_scan"], 0.86, 0.90),
        "signature_brute_force": (["brute_force"], 0.80, 0.86),
        "signature_ssh": (["ssh_suspicious"], 0.72, 0.78),
    }
    ready = _s("rule_pred") & (_s("support") >= (0.04 if balanced else 0.08))
    return [
        Outcome(
            ready & _s("family").isin(families) & (_s("rule_confidence") >= (low if balanced else high)),
            "contextual_support", "heuristic_signature", V.DECISION_REASONS[reason],
        )
        for reason, (families, low, high) in least.items()
    ]


def _ranked_rules(cfg: DecisionConfig) -> list[Outcome]:
    """Rules of a profile in order; the first that matches decides."""
    why = V.DECISION_REASONS
    band, label = _s("band"), _s("label")
    raised = band.isin("medium", "high")
    both = (_s("if_pred") == 1) & (_s("ae_pred") == 1) & raised & (label != "suppressive")
    ae_hit = _s("ae_pred") == 1
    ae_high = ae_hit  # a strong signal needs a prediction as well
    ae_medium = ae_hit | (_s("ae_signal") >= 0.30)
    if cfg.profile == "conservative":
        supported = label == "supportive"
        high, medium = (band == "high") & ae_high, (band == "medium") & ae_medium
        silenced = label == "suppressive"
        quiet = "suppressed_by_context"
        return [
            Outcome(both, "full_agreement", "if+ae", why["c_agree"]),
            Outcome(high & silenced, quiet, quiet, why["c_high_suppressed"], attack=False),
            Outcome(high, "ae_primary", "ae_high_risk", why["c_high"]),
            Outcome(medium & silenced, quiet, quiet, why["c_medium_suppressed"], attack=False),
            Outcome(medium & supported, "contextual_agreement", "ae_contextual_band", why["c_medium_supported"]),
            Outcome(medium, "ae_primary", "ae_medium_risk", why["c_medium"]),
        ]
    context = label.isin("supportive", "contextual")
    if_medium, if_high = _s("if_signal") >= 0.20, _s("if_signal") >= 0.45
    ensemble = F.coalesce(_s("ensemble"), F.lit(-1.0))
    moderate = _s("ensemble_pred") | (ensemble >= clamp_number(cfg.moderate))
    supported = _s("support") >= clamp_number(cfg.moderate)
    return [
        Outcome(
            (label == "supportive") & (ensemble >= min(clamp_number(cfg.moderate * 0.55), 0.25)),
            "contextual_support", "heuristic_guided_attack", why["b_supportive"],
        ),
        Outcome(
            (label == "contextual")
            & (ensemble >= min(clamp_number(cfg.strong * 0.60), 0.35))
            & (raised | if_medium),
            "contextual_support", "contextual_attack", why["b_contextual"],
        ),
        Outcome(both, "full_agreement", "if+ae", why["b_agree"]),
        Outcome(
            ae_high & (band == "high") & (moderate | context | if_medium | supported),
            F.when(moderate & if_medium, "full_agreement").when(context, "contextual_agreement").otherwise("ae_primary"),
            "ae_high_risk", why["b_high"],
        ),
        Outcome(
            ae_medium & (band == "medium") & (moderate | supported | (context & if_medium)),
            F.when(context | moderate, "contextual_agreement").otherwise("ae_primary"),
            F.when(context, "ae_contextual_band").otherwise("ae_medium_risk"), why["b_medium"],
        ),
        Outcome(
            (ensemble >= clamp_number(cfg.strong)) & (context | if_high | ae_medium),
            "contextual_support", "ensemble_support", why["b_ensemble"],
        ),
    ]


def clamp_number(value: float) -> float:
    return min(max(value, 0.0), 1.0)


def _verdict(rules: list[Outcome]) -> Column:
    def row(rule: Outcome) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            F.lit(rule.attack).alias("attack"),
            text(rule.agreement).alias("agreement"),
            text(rule.source).alias("source"),
            text(rule.reason).alias("reason"),
        )

    chain = None
    for rule in rules:
        hit = F.coalesce(rule.when, F.lit(False))
        chain = F.when(hit, row(rule)) if chain is None else chain.when(hit, row(rule))
    safe = Outcome(F.lit(True), "full_agreement_negative", "safe_negative", V.DECISION_REASONS["safe"], attack=False)
    return chain.otherwise(row(safe))


def _confidence(cfg: DecisionConfig) -> Column:
    """Confidence in the verdict."""
    agreement, attack = F.col("agreement_level"), F.col("is_anomaly")
    # Share of the agreement boost per level.
    shares = {"full_agreement": 1.0, "contextual_agreement": 0.50, "contextual_support": 0.35, "ae_primary": 0.25}
    gain = F.lit(0.0)
    for level, share in shares.items():
        gain = F.when(agreement == level, cfg.agreement * share).otherwise(gain)
    positive = F.greatest(_s("support"), _s("if_signal"), _s("ae_signal"), _s("rule_signal")) + gain
    positive = F.when(_s("context") < 0, positive + _s("context") * 0.50).otherwise(positive)
    calm = (
        F.when(agreement == "full_agreement_negative", cfg.safe_negative)
        .when(agreement == "suppressed_by_context", cfg.safe_negative * 0.50)
        .otherwise(0.0)
    )
    negative = F.greatest(
        F.col("base_negative_support"), clamp((_s("if_confidence") + _s("ae_confidence")) / 2.0)
    ) + calm
    return clamp(F.when(attack, positive).otherwise(negative))


def decide(
    df: DataFrame,
    config: DecisionConfig | None = None,
    *,
    profile: str | None = None,
    prioritize_precision: bool | None = None,
    ae_reference: float | str | None = None,
) -> DataFrame:
    """Verdict, family, confidence, risk and explanation of every window.

    Reads the detector, rule and (when present) ensemble columns; every step is a
    narrow projection.
    """
    cfg = decision_profile(config, profile, prioritize_precision)
    if ae_reference is None:
        ae_reference = next(
            (n for n in ("ensemble_ae_reference", "ae_threshold_raw") if n in df.columns), 0.0
        )
    reference = F.col(ae_reference) if isinstance(ae_reference, str) else F.lit(float(ae_reference))
    columns = df.columns
    df = _signals(df, cfg, reference)
    df = df.withColumn("_v", _verdict(_signature(cfg) + _ranked_rules(cfg)))
    strongest = F.greatest(clamp(_s("if_confidence")), clamp(_s("ae_confidence")))
    suppressed = F.when(_s("label") == "suppressive", cfg.safe_negative * 0.50).otherwise(0.0)
    df = df.withColumns(
        {
            "is_anomaly": F.col("_v.attack"),
            "agreement_level": F.col("_v.agreement"),
            "decision_source": F.col("_v.source"),
            "decision_reason": F.col("_v.reason"),
            "base_attack_support": _s("support"),
            "base_negative_support": clamp((1.0 - _s("support")) + suppressed + strongest * 0.05),
        }
    )
    df = df.withColumn("confidence", _confidence(cfg))
    attack, sure, source = F.col("is_anomaly"), F.col("confidence"), F.col("decision_source")
    df = df.withColumns(
        {
            "pred_decision_engine": attack.cast("int"),
            "decision_runtime_profile": F.lit(cfg.profile),
            "final_label": F.when(attack, "anomaly").otherwise("normal"),
            "attack_type": F.when(~attack, "normal").when(_s("family") != "normal", _s("family")).otherwise("unknown_anomaly"),
            "risk_level": F.when(attack & (sure >= 0.78), "high")
            .when(attack & (sure >= 0.55), "medium")
            .when(attack | (sure >= 0.70), "low")
            .otherwise("medium"),
            "explanation": F.col("decision_reason"),
            "isolation_score": F.col("score_if").cast("double"),
            "autoencoder_score": _s("ae_raw"),
            "conflict_winner": F.when(source == "if+ae", "if+ae")
            .when(source.startswith("ae_"), "ae_primary")
            .when(
                source.isin("ensemble_support", "heuristic_guided_attack", "contextual_attack", "heuristic_signature"),
                "contextual_support",
            )
            .when(source == "suppressed_by_context", "heuristic_filter")
            .when(~attack & (_s("if_pred") == 1) & (_s("ae_pred") == 0), "if_filtered")
            .when(~attack & (_s("ae_pred") == 1) & (_s("label") == "suppressive"), "heuristic_filter")
            .otherwise("safe_negative"),
        }
    )
    added = [
        "pred_decision_engine", "decision_runtime_profile", "is_anomaly", "final_label", "attack_type",
        "risk_level", "confidence", "explanation", "isolation_score", "autoencoder_score", "decision_source",
        "agreement_level", "decision_reason", "conflict_winner", "base_attack_support", "base_negative_support",
    ]
    return df.select(*[n for n in columns if n not in added], *added)
