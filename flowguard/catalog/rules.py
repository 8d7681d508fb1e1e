"""Behaviour-rule, ensemble and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.catalog import tables
from flowguard.catalog.tables import HIST
from flowguard.catalog.windows import MODES_SQL, SCAN_SQL, fw_windows, rules_sql, scan_windows
from flowguard.config import EnsembleConfig, decision_profile, ensemble_profile
from flowguard.operators.decision import decide
from flowguard.operators.ensemble import ai_support, ensemble_support, weighted_ensemble
from flowguard.operators.rules import analyze_behaviour, flag_map, port_list, refine_with_context, window_instant

VERDICT = ("window_id", "heuristic_detected_attack", "heuristic_attack_type", "heuristic_confidence")


def rules_all(spark, folder):
    return analyze_behaviour(fw_windows(spark, folder)).select(*VERDICT)


def rules_port_scan(spark, folder):
    return analyze_behaviour(scan_windows(spark, folder)).select(*VERDICT)


def rule_reasons(spark, folder):
    return (
        analyze_behaviour(fw_windows(spark, folder))
        .groupBy("heuristic_attack_type", "heuristic_reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def port_sets(spark, folder):
    """F18-F19 over the summaries of the windows."""
    w = fw_windows(spark, folder)
    flags = flag_map(F.col("tcp_flags_summary"))
    return w.select(
        "window_id",
        F.array_join(port_list(F.col("common_destination_ports")).cast("array<string>"), "/").alias("ports"),
        *[F.coalesce(F.try_element_at(flags, F.lit(n)), F.lit(0)).alias(f"flag_{n.lower()}") for n in ("S", "PA", "A")],
    )


def window_times(spark, folder):
    """F21 from the identifier alone."""
    w = fw_windows(spark, folder).select("window_id")
    return w.select("window_id", window_instant(w).alias("window_time"))


def ssh_windows(spark: SparkSession, folder: str) -> DataFrame:
    """One small SSH window per event, thirty seconds apart, some of them strong."""
    strong = F.col("user_id") % 5 == 0
    size = F.when(strong, 10).otherwise(F.when(F.col("event_id") % 3 == 0, 1).otherwise(2))
    pa = F.when(strong, 8).otherwise(1)
    return tables.table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("window_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id") * 30)).alias("window_start"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("source_ip"),
        F.concat(F.lit("192.168.1."), (F.col("event_id") % 2).cast("string")).alias("destination_ip_sample"),
        F.lit("tcp").alias("protocol"), F.lit("block").alias("action"),
        size.cast("double").alias("connections"), size.cast("double").alias("packets"),
        (size * 90.0).alias("bytes"), F.lit(90.0).alias("packet_size"), F.lit(1.0).alias("ports"),
        F.lit(1).alias("destination_ip_count"), F.lit(1).alias("destination_port_count"),
        F.lit("22").alias("common_destination_ports"), F.lit(22).alias("destination_port_min"), F.lit(22).alias("destination_port_max"),
        F.lit(0).alias("tcp_syn_count"), pa.alias("tcp_pa_count"), F.concat(F.lit("PA:"), pa.cast("string")).alias("tcp_flags_summary"),
        size.alias("blocked_count"), F.lit(0).alias("passed_count"),
    )


def ssh_context(spark, folder):
    return refine_with_context(analyze_behaviour(ssh_windows(spark, folder))).select(
        "window_id", "heuristic_attack_type", "heuristic_confidence"
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Given detector and rule outputs, from the history projection."""
    h = tables.hist(spark, folder)
    kind = F.coalesce("attack_type", F.lit("normal"))
    kind = F.when(F.col("id") % 9 == 0, "ddos").when(F.col("id") % 10 == 0, "unknown").otherwise(kind)
    value = F.col("autoencoder_score")
    norm = F.least(value / 2, F.lit(1.0))
    return h.select(
        "id",
        (F.col("if_norm") - 0.5).alias("score_if"),
        F.col("if_norm").alias("score_if_normalized"),
        F.col("if_pred").alias("pred_if"),
        F.when(F.col("if_pred") == 1, F.col("if_norm")).otherwise(1.0 - F.col("if_norm")).alias("if_confidence"),
        value.alias("score_ae"),
        norm.alias("score_ae_normalized"),
        F.col("ae_pred").alias("pred_ae"),
        F.when(F.col("ae_pred") == 1, norm).otherwise(1.0 - norm).alias("ae_confidence"),
        (kind != "normal").alias("heuristic_detected_attack"),
        kind.alias("heuristic_attack_type"),
        (F.lit(0.5) + F.col("if_norm") * 0.45).alias("heuristic_confidence"),
        F.lit("").alias("heuristic_reason"),
    )


ENSEMBLE_OUT = (
    "ensemble_ae_risk_band", "ensemble_ae_risk_score", "ensemble_if_alert_score", "ensemble_agreement_score",
    "ensemble_conflict_penalty", "ensemble_score", "pred_ensemble",
)


def _rounded(df: DataFrame, names, keep) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keep, *[(F.round(n, 9) if kinds[n] == "double" else F.col(n)).alias(n) for n in names])


def _ensemble(profile: str):
    def run(spark, folder):
        df = ensemble_support(scores(spark, folder), profile=profile, ae_reference=1.0)
        return _rounded(df, ENSEMBLE_OUT, ["id"])

    return run


DECISION_OUT = (
    "is_anomaly", "final_label", "attack_type", "risk_level", "confidence", "decision_source", "agreement_level",
    "conflict_winner", "base_attack_support", "base_negative_support",
)


def _decision(profile: str):
    def run(spark, folder):
        df = ensemble_support(scores(spark, folder), profile=profile, ae_reference=1.0)
        return _rounded(decide(df, profile=profile), DECISION_OUT, ["id"])

    return run


def ensemble_weighted(spark, folder):
    df = weighted_ensemble(scores(spark, folder), EnsembleConfig())
    return _rounded(df, ("if_score_scaled", "ae_score_scaled", "support_score", "support_pred"), ["id"])


def ai_flags(spark, folder):
    df = ai_support(scores(spark, folder).withColumn("ensemble_score", F.col("score_ae") / 8))
    return df.select(
        "id", "ai_support", "ai_support_conservative", "ai_support_type", "ai_support_level",
        F.col("ai_support_signals.isolation_forest.passed").alias("forest_passed"),
        F.col("ai_support_signals.conservative_passed").alias("all_passed"),
        "ai_support_reason",
    )


QUERIES = {
    "rules_all": rules_all,
    "rules_port_scan": rules_port_scan,
    "rule_reasons": rule_reasons,
    "port_sets": port_sets,
    "window_times": window_times,
    "ssh_context": ssh_context,
    "ensemble_support": _ensemble("balanced"),
    "ensemble_support_conservative": _ensemble("conservative"),
    "ensemble_weighted": ensemble_weighted,
    "ai_support": ai_flags,
    "decision_balanced": _decision("balanced"),
    "decision_conservative": _decision("conservative"),
}

_VERDICT = "SELECT window_id, heuristic_attack_type <> 'normal' AS heuristic_detected_attack, heuristic_attack_type, heuristic_confidence FROM verdict"
# Reason texts of the rules and of the AI support, as the windows must show them.
REASON_SQL = """CASE WHEN kind = 'port_scan' THEN 'Muitas conexoes SYN para muitas portas de destino em uma janela curta sugerem atividade de port scan.'
 WHEN kind = 'syn_flood' THEN 'Predominio de pacotes SYN pequenos e bloqueados para poucas portas e poucos destinos e compativel com syn flood.'
 WHEN kind = 'ddos' THEN 'Volume anormalmente alto de conexoes, bytes ou pacotes sugere padrao compativel com DDoS.'
 WHEN kind = 'brute_force' THEN 'Tentativas repetidas e bloqueadas em porta sensivel, especialmente SSH, sao compativeis com brute force.'
 WHEN kind = 'ssh_suspicious' THEN 'Bloqueios repetidos em porta de administracao, especialmente 22/TCP, indicam atividade SSH suspeita.'
 WHEN kind = 'unknown_anomaly' THEN 'O grupo apresentou bloqueios e padroes de flags ou portas fora do esperado, mas sem assinatura heuristica forte para uma familia especifica.'
 WHEN benign THEN 'Padrao compativel com trafego benigno de saida em portas comuns, sem assinatura forte de varredura ou bloqueio.'
 ELSE 'Nenhuma regra comportamental forte foi acionada.' END"""
SUPPORT_SQL = """CASE WHEN st THEN 'ensemble_score, autoencoder_score e score_if_normalized atingiram os limiares conservadores de suporte da IA; metadado auxiliar sem alterar final_label, attack_type ou risk_level.'
 WHEN en THEN 'ensemble_score atingiu o limiar calibrado de suporte da IA; metadado auxiliar sem alterar final_label, attack_type ou risk_level.'
 ELSE 'Nenhum criterio calibrado de suporte da IA foi atingido; a decisao final permanece inalterada.' END"""
_SCORES = f"""
h AS ({HIST}),
s AS (SELECT id, if_norm - 0.5 AS score_if, if_norm AS score_if_normalized, if_pred AS pred_if,
  CASE WHEN if_pred = 1 THEN if_norm ELSE 1 - if_norm END AS if_confidence, autoencoder_score AS score_ae,
  least(autoencoder_score / 2, 1) AS score_ae_normalized, ae_pred AS pred_ae,
  CASE WHEN ae_pred = 1 THEN least(autoencoder_score / 2, 1) ELSE 1 - least(autoencoder_score / 2, 1) END AS ae_confidence,
  CASE WHEN id % 9 = 0 THEN 'ddos' WHEN id % 10 = 0 THEN 'unknown' ELSE coalesce(attack_type, 'normal') END AS kind,
  0.5 + if_norm * 0.45 AS rc FROM h)
"""


def _ensemble_sql(profile: str, scores: str = _SCORES) -> str:
    c = ensemble_profile(profile=profile)
    wi, wa = c.weights()
    low = f"OR alert >= {c.strong}" if profile == "balanced" else ""
    return f"""{scores.strip()},
e1 AS (SELECT *, least(score_ae, 1) AS ratio1, 1 / (1 + exp(-((score_if - ({c.alert_center})) / {c.alert_scale}))) AS base,
  CASE WHEN pred_ae = 1 AND (score_ae_normalized >= {c.strong} OR score_ae >= 1.5 OR score_ae >= 0.64) THEN 'high'
   WHEN pred_ae = 1 OR (score_ae_normalized >= {c.moderate} AND score_ae >= 0.75) OR score_ae >= 0.32 THEN 'medium' ELSE 'low' END AS band FROM s),
e2 AS (SELECT *, CASE WHEN pred_ae = 1 THEN greatest(score_ae_normalized, ratio1) ELSE greatest(score_ae_normalized * 0.25, ratio1 * 0.15) END AS risk,
  CASE WHEN pred_if = 1 THEN greatest(base, {c.alert_floor}, score_if_normalized) ELSE least(base, score_if_normalized) * 0.25 END AS alert FROM e1),
e3 AS (SELECT *, CASE WHEN pred_if = 1 AND pred_ae = 1 THEN least(risk, alert) ELSE 0 END AS agree,
  CASE WHEN pred_if = 1 AND band = 'medium' THEN {c.conflict} * 0.6 WHEN pred_if = 1 AND band = 'low' THEN {c.conflict} ELSE 0 END AS conflict,
  CASE band WHEN 'medium' THEN {c.medium_boost} WHEN 'high' THEN {c.high_boost} ELSE 0 END AS boost FROM e2),
e4 AS (SELECT *, greatest(0, least(1, risk * CAST({wa} AS DOUBLE) + alert * CAST({wi} AS DOUBLE) + agree * {c.agreement} + boost - conflict)) AS ens FROM e3),
e AS (SELECT *, CASE WHEN ens >= {c.support_threshold()} AND (band <> 'low' {low}) THEN 1 ELSE 0 END AS ens_pred FROM e4)"""


def _decision_sql(profile: str, scores: str = _SCORES) -> str:
    c = decision_profile(profile=profile)
    balanced = profile == "balanced"
    if balanced:
        family_label = "contextual"
        family_score = f"least(1, greatest(0, greatest(rc, 0.45) * (CASE WHEN fam = 'brute_force' THEN {c.contextual} * 0.85 ELSE {c.contextual} END)))"
        rules = f"""
   WHEN label = 'supportive' AND ens >= {min(c.moderate * 0.55, 0.25)} THEN 1
   WHEN label = 'contextual' AND ens >= {min(c.strong * 0.60, 0.35)} AND (zone IN ('medium','high') OR si >= 0.20) THEN 2
   WHEN pred_if = 1 AND pred_ae = 1 AND zone IN ('medium','high') THEN 3
   WHEN pred_ae = 1 AND zone = 'high' AND (me OR ctx OR si >= 0.20 OR sup >= {c.moderate}) THEN 4
   WHEN (pred_ae = 1 OR sa >= 0.30) AND zone = 'medium' AND (me OR sup >= {c.moderate} OR (ctx AND si >= 0.20)) THEN 5
   WHEN ens >= {c.strong} AND (ctx OR si >= 0.45 OR pred_ae = 1 OR sa >= 0.30) THEN 6"""
        table = """CASE rule WHEN 0 THEN ['contextual_support','heuristic_signature'] WHEN 1 THEN ['contextual_support','heuristic_guided_attack']
   WHEN 2 THEN ['contextual_support','contextual_attack'] WHEN 3 THEN ['full_agreement','if+ae']
   WHEN 4 THEN [CASE WHEN me AND si >= 0.20 THEN 'full_agreement' WHEN ctx THEN 'contextual_agreement' ELSE 'ae_primary' END,'ae_high_risk']
   WHEN 5 THEN [CASE WHEN ctx OR me THEN 'contextual_agreement' ELSE 'ae_primary' END, CASE WHEN ctx THEN 'ae_contextual_band' ELSE 'ae_medium_risk' END]
   WHEN 6 THEN ['contextual_support','ensemble_support'] ELSE ['full_agreement_negative','safe_negative'] END"""
        least = (0.04, 0.84, 0.86, 0.80, 0.72)
    else:
        family_label = "suppressive"
        family_score = f"-least(1, greatest(0, greatest(rc, 0.70) * (CASE WHEN fam = 'port_scan' THEN {c.suppressive} ELSE {c.suppressive} * 0.85 END)))"
        rules = """
   WHEN pred_if = 1 AND pred_ae = 1 AND zone IN ('medium','high') AND label <> 'suppressive' THEN 1
   WHEN zone = 'high' AND pred_ae = 1 THEN CASE WHEN label = 'suppressive' THEN 20 ELSE 2 END
   WHEN zone = 'medium' AND (pred_ae = 1 OR sa >= 0.30) THEN CASE WHEN label = 'suppressive' THEN 20 WHEN label = 'supportive' THEN 3 ELSE 4 END"""
        table = """CASE rule WHEN 0 THEN ['contextual_support','heuristic_signature'] WHEN 1 THEN ['full_agreement','if+ae']
   WHEN 2 THEN ['ae_primary','ae_high_risk'] WHEN 3 THEN ['contextual_agreement','ae_contextual_band'] WHEN 4 THEN ['ae_primary','ae_medium_risk']
   WHEN 20 THEN ['suppressed_by_context','suppressed_by_context'] ELSE ['full_agreement_negative','safe_negative'] END"""
        least = (0.08, 0.90, 0.90, 0.86, 0.78)
    return f"""WITH {_ensemble_sql(profile, scores)},
d1 AS (SELECT *, kind <> 'normal' AS hit, CASE WHEN kind = 'unknown' THEN 'unknown_anomaly' ELSE kind END AS fam,
  CASE WHEN pred_ae = 1 AND (score_ae_normalized >= {c.strong} OR score_ae >= 1.5 OR score_ae >= 0.64) THEN 'high'
   WHEN pred_ae = 1 OR (score_ae_normalized >= {c.moderate} AND score_ae >= 0.75) OR score_ae >= 0.32 THEN 'medium' ELSE 'low' END AS own,
  CASE WHEN pred_if = 1 THEN greatest(score_if_normalized, 0.55) ELSE greatest(score_if_normalized - 0.85, 0) * 1.5 END AS si,
  CASE WHEN pred_ae = 1 THEN greatest(score_ae_normalized, 0.60) ELSE score_ae_normalized * 0.25 END AS sa FROM e),
d2 AS (SELECT *, CASE WHEN fam IN ('unknown_anomaly','ddos','syn_flood') THEN 'supportive'
   WHEN fam IN ('port_scan','brute_force','ssh_suspicious') THEN '{family_label}' ELSE 'neutral' END AS label,
  CASE WHEN fam IN ('unknown_anomaly','ddos','syn_flood') THEN rc * ({c.supportive} * (CASE WHEN fam = 'ddos' THEN 0.65 ELSE 1.0 END))
   WHEN fam IN ('port_scan','brute_force','ssh_suspicious') THEN {family_score} ELSE 0 END AS cs,
  CASE WHEN NOT hit THEN 0 WHEN fam IN ('syn_flood','ddos') THEN greatest(rc * 0.92, 0.65) WHEN fam = 'port_scan' THEN greatest(rc * 0.88, 0.60)
   WHEN fam = 'brute_force' THEN greatest(rc * 0.84, 0.56) WHEN fam = 'ssh_suspicious' THEN greatest(rc * 0.78, 0.45) ELSE rc * 0.70 END AS sr,
  CASE WHEN pred_ae = 0 AND own = 'low' AND band IN ('medium','high') THEN own ELSE band END AS zone FROM d1),
d3 AS (SELECT *, greatest(0, least(1, ens + cs)) AS sup, label IN ('supportive','contextual') AS ctx,
  ens_pred = 1 OR ens >= {c.moderate} AS me FROM d2),
d4 AS (SELECT *, CASE
   WHEN hit AND sup >= {least[0]} AND ((fam IN ('syn_flood','ddos') AND rc >= {least[1]}) OR (fam = 'port_scan' AND rc >= {least[2]})
     OR (fam = 'brute_force' AND rc >= {least[3]}) OR (fam = 'ssh_suspicious' AND rc >= {least[4]})) THEN 0 {rules} ELSE 99 END AS rule FROM d3),
d5 AS (SELECT *, rule < 20 AS atk, {table} AS v,
  greatest(0, least(1, 1 - sup + CASE WHEN label = 'suppressive' THEN {c.safe_negative} * 0.5 ELSE 0 END + greatest(if_confidence, ae_confidence) * 0.05)) AS neg FROM d4),
d6 AS (SELECT *, greatest(0, least(1, CASE WHEN atk THEN greatest(sup, si, sa, sr)
    + CASE v[1] WHEN 'full_agreement' THEN {c.agreement} WHEN 'contextual_agreement' THEN {c.agreement} * 0.5
      WHEN 'contextual_support' THEN {c.agreement} * 0.35 WHEN 'ae_primary' THEN {c.agreement} * 0.25 ELSE 0 END
    + CASE WHEN cs < 0 THEN cs * 0.5 ELSE 0 END
   ELSE greatest(neg, (if_confidence + ae_confidence) / 2)
    + CASE v[1] WHEN 'full_agreement_negative' THEN {c.safe_negative} WHEN 'suppressed_by_context' THEN {c.safe_negative} * 0.5 ELSE 0 END END)) AS conf FROM d5)
SELECT id, atk AS is_anomaly, CASE WHEN atk THEN 'anomaly' ELSE 'normal' END AS final_label,
 CASE WHEN NOT atk THEN 'normal' WHEN fam <> 'normal' THEN fam ELSE 'unknown_anomaly' END AS attack_type,
 CASE WHEN atk AND conf >= 0.78 THEN 'high' WHEN atk AND conf >= 0.55 THEN 'medium' WHEN atk OR conf >= 0.70 THEN 'low' ELSE 'medium' END AS risk_level,
 round(conf, 9) AS confidence, v[2] AS decision_source, v[1] AS agreement_level,
 CASE WHEN v[2] = 'if+ae' THEN 'if+ae' WHEN starts_with(v[2], 'ae_') THEN 'ae_primary'
  WHEN v[2] IN ('ensemble_support','heuristic_guided_attack','contextual_attack','heuristic_signature') THEN 'contextual_support'
  WHEN v[2] = 'suppressed_by_context' THEN 'heuristic_filter' WHEN NOT atk AND pred_if = 1 AND pred_ae = 0 THEN 'if_filtered'
  WHEN NOT atk AND pred_ae = 1 AND label = 'suppressive' THEN 'heuristic_filter' ELSE 'safe_negative' END AS conflict_winner,
 round(sup, 9) AS base_attack_support, round(neg, 9) AS base_negative_support FROM d6"""


def _ensemble_select(profile: str) -> str:
    return f"""WITH {_ensemble_sql(profile)} SELECT id, band AS ensemble_ae_risk_band, round(risk, 9) AS ensemble_ae_risk_score,
 round(alert, 9) AS ensemble_if_alert_score, round(agree, 9) AS ensemble_agreement_score, round(conflict, 9) AS ensemble_conflict_penalty,
 round(ens, 9) AS ensemble_score, ens_pred AS pred_ensemble FROM e"""


_SSH = """
w AS (SELECT CAST(event_id AS VARCHAR) AS window_id, TIMESTAMP '2024-01-01' + to_seconds(event_id * 30) AS ws,
  user_id % 7 AS src, event_id % 2 AS dst, user_id % 5 = 0 AS strong,
  CASE WHEN user_id % 5 = 0 THEN 10 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS size FROM events)
SELECT window_id, CASE WHEN strong OR near THEN 'brute_force' ELSE 'ssh_suspicious' END AS heuristic_attack_type,
 CASE WHEN strong THEN 0.93 WHEN near THEN least(0.91, greatest(0.84 + 0.05, 0.9)) WHEN size >= 2 THEN 0.84 ELSE 0.82 END AS heuristic_confidence
FROM (SELECT *, NOT strong AND size >= 2 AND EXISTS (SELECT 1 FROM w a WHERE a.strong AND a.src = w.src AND a.dst = w.dst
   AND a.ws <> w.ws AND a.ws BETWEEN w.ws - INTERVAL 120 SECOND AND w.ws + INTERVAL 120 SECOND) AS near FROM w)
"""
_C = EnsembleConfig()
ORACLES = {
    "rules_all": rules_sql(MODES_SQL, _VERDICT),
    "rules_port_scan": rules_sql(SCAN_SQL, _VERDICT),
    "rule_reasons": rules_sql(
        MODES_SQL,
        f"SELECT kind AS heuristic_attack_type, {REASON_SQL} AS heuristic_reason, count(*) AS n FROM (SELECT *, heuristic_attack_type AS kind FROM verdict) GROUP BY 1, 2",
    ),
    "port_sets": rules_sql(
        MODES_SQL,
        """SELECT window_id, array_to_string(pl, '/') AS ports,
 coalesce(CAST(nullif(regexp_extract(tcp_flags_summary, '(^|,)S:([0-9]+)', 2), '') AS INT), 0) AS flag_s,
 coalesce(CAST(nullif(regexp_extract(tcp_flags_summary, '(^|,)PA:([0-9]+)', 2), '') AS INT), 0) AS flag_pa,
 coalesce(CAST(nullif(regexp_extract(tcp_flags_summary, '(^|,)A:([0-9]+)', 2), '') AS INT), 0) AS flag_a FROM p""",
    ),
    "window_times": f"SELECT window_id, window_start AS window_time FROM ({MODES_SQL})",
    "ssh_context": f"WITH {_SSH.strip()}",
    "ensemble_support": _ensemble_select("balanced"),
    "ensemble_support_conservative": _ensemble_select("conservative"),
    "ensemble_weighted": f"""WITH {_SCORES.strip()},
t AS (SELECT id, score_if, ln(1 + score_ae) AS l FROM s),
x AS (SELECT min(score_if) AS il, max(score_if) AS ih, min(l) AS al, max(l) AS ah FROM t),
n AS (SELECT id, (score_if - il) / (ih - il) AS a, (l - al) / (ah - al) AS b FROM t, x)
SELECT id, round(a, 9) AS if_score_scaled, round(b, 9) AS ae_score_scaled, round(b * CAST({_C.weights()[1]} AS DOUBLE) + a * CAST({_C.weights()[0]} AS DOUBLE), 9) AS support_score,
 CASE WHEN b * CAST({_C.weights()[1]} AS DOUBLE) + a * CAST({_C.weights()[0]} AS DOUBLE) >= 0.55 THEN 1 ELSE 0 END AS support_pred FROM n""",
    "ai_support": f"""WITH {_SCORES.strip()}, f AS (SELECT *, score_ae / 8 >= 0.05 AS en, score_if_normalized >= 0.82 AS fo, score_ae / 8 >= 0.05 AND score_ae >= 1.0 AND score_if_normalized >= 0.82 AS st FROM s)
SELECT id, en AS ai_support, st AS ai_support_conservative,
 CASE WHEN st THEN 'ensemble_autoencoder_if' WHEN en THEN 'ensemble_score' ELSE 'none' END AS ai_support_type,
 CASE WHEN st THEN 'strong' WHEN en THEN 'moderate' ELSE 'none' END AS ai_support_level, fo AS forest_passed, st AS all_passed,
 {SUPPORT_SQL} AS ai_support_reason FROM f""",
    "decision_balanced": _decision_sql("balanced"),
    "decision_conservative": _decision_sql("conservative"),
}
