"""Dataset, quality, metric, sampling and detector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.catalog import tables
from flowguard.catalog.rules import _ensemble_sql, scores
from flowguard.catalog.tables import HIST
from flowguard.catalog.windows import MODES_SQL, fw_windows
from flowguard.functions.features import extract_label, normalize_labels, sanitize_numeric, with_features
from flowguard.operators import evaluation as E
from flowguard.operators import sampling as S
from flowguard.operators.distributions import column_profile, numeric_summary, quality_audit
from flowguard.operators.ensemble import ensemble_sweep, sweep_candidates
from flowguard.operators.forest import ForestConfig, fit_forest, score_forest
from flowguard.operators.quantiles import exact_percentiles
from flowguard.operators.reconstruction import fit_reconstruction, score_reconstruction, vector_columns
from flowguard.operators.reports import inference_counts, inference_numbers, row_reports
from flowguard.operators.scaling import fit_scaler
from flowguard.operators.scores import normalise_score, score_statistics
from flowguard.plans.batch import fit_models, score_windows
from flowguard.plans.train import train_tuned, evaluate_splits
from flowguard.session import cut_lineage
from flowguard.sources.datasets import prepare_dataset, standardise_flows, standardise_positional

LABEL_TEXT = {0: "BENIGN", 1: " Normal ", 2: "DoS", 3: "0", 4: "normal_traffic", 5: "Bot", 6: "0.0"}


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled flow rows from ``lineitem``."""
    kind = F.col("l_partkey") % 7
    text = F.lit("BENIGN")
    for i, name in LABEL_TEXT.items():
        text = F.when(kind == i, name).otherwise(text)
    return tables.table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_suppkey").cast("string").alias(" Flow Duration"),
        F.when(F.col("l_partkey") % 13 == 0, "Infinity").otherwise(F.col("l_extendedprice").cast("string")).alias("Total Length of Fwd Packets"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity")).alias("Total Fwd Packets "),
        (F.col("l_discount") * 100).alias("Average Packet Size"),
        (F.col("l_partkey") % 65536).cast("string").alias("Destination Port"),
        text.alias("Label"),
    )


def features_13(spark, folder):
    base = standardise_flows(flows(spark, folder)).drop("label")
    wide = with_features(base)
    return wide.groupBy().agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(n), 2).alias(n) for n in V.BASE_FEATURES + ["log1p_ports", "packets_per_connection"]]
    )


def sanitise(spark, folder):
    raw = flows(spark, folder).withColumnsRenamed({"Total Length of Fwd Packets": "b", "Total Fwd Packets ": "p"})
    return sanitize_numeric(raw.select("row_id", "b", "p"), ["b", "p"])


def label_extract(spark, folder):
    return extract_label(flows(spark, folder).select("row_id", "Label"))


def label_normalise(spark, folder):
    return normalize_labels(flows(spark, folder).select("row_id", F.col("Label").alias("label")))


def dataset_flows(spark, folder):
    return standardise_flows(flows(spark, folder))


def dataset_positional(spark, folder):
    li = tables.table(spark, folder, "lineitem")
    places = {1: "l_suppkey", 3: "l_partkey", 7: "l_extendedprice", 16: "l_quantity"}
    wide = li.select(
        *[F.col(places[i]).cast("string").alias(f"_c{i}") if i in places else F.lit("x").alias(f"_c{i}") for i in range(44)],
        F.col("l_returnflag").alias("_c44"),
    )
    return standardise_positional(wide)


def dataset_targets(spark, folder):
    return E.target_counts(prepare_dataset(standardise_flows(flows(spark, folder))), "target", ["label"])


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Quality is the truth and toxic the prediction; three splits by id."""
    part = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "validation").otherwise("test")
    return tables.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("pred"), part.alias("split"))


def dq_audit(spark, folder):
    raw = tables.hist(spark, folder).select(
        F.when(F.col("id") % 7 != 0, F.col("ensemble_score")).alias("a"),
        F.when(F.col("id") % 5 == 0, F.lit("inf").cast("double")).otherwise(F.col("if_norm") - 0.5).alias("b"),
        F.col("if_pred").alias("c"),
    )
    return quality_audit(raw, ["a", "b", "c", "d"]).drop("dtype")


def profile_columns(spark, folder):
    rows = tables.hist(spark, folder).select("risk_level", "if_pred", "if_norm", (F.col("id") % 50).alias("id_mod"), "attack_type")
    out = column_profile(rows, ["risk_level", "if_pred", "if_norm", "id_mod", "attack_type"])
    first = F.get("top_counts", F.lit(0))
    return out.select(
        "column", "kind", "unique_values", first["value"].alias("top_value"), first["n"].alias("top_n"),
        F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("mean", 6).alias("mean"),
    )


def summary_numbers(spark, folder):
    out = numeric_summary(tables.hist(spark, folder), ["ensemble_score", "if_norm", "if_pred"])
    return out.select("column", *[F.round(n, 9).alias(n) for n in ("min", "max", "mean")])


def score_stats(spark, folder):
    out = score_statistics(tables.hist(spark, folder), "autoencoder_score")
    return out.select(*[F.round(n, 9).alias(n) for n in out.columns])


def score_normalise(spark, folder):
    out = normalise_score(tables.hist(spark, folder), "autoencoder_score", "normalised")
    return out.select("id", F.round("normalised", 9).alias("normalised"))


def pct_threshold(spark, folder):
    h = tables.hist(spark, folder)
    found = exact_percentiles(h, "autoencoder_score", [80, 85, 90, 95])
    rows = F.array(*[F.struct(F.lit(p).alias("percentile"), F.lit(v).alias("threshold")) for p, v in zip((80, 85, 90, 95), found)])
    over = F.count_if(F.col("autoencoder_score") > F.col("threshold")).alias("over")
    return h.select("autoencoder_score", F.inline(rows)).groupBy("percentile", F.round("threshold", 9).alias("threshold")).agg(over)


def confusion(spark, folder):
    return E.confusion(judged(spark, folder), "truth", "pred")


_METRIC_COLUMNS = ["precision", "recall", "f1_score", "accuracy", "specificity", "false_positive_rate", "selection_score"]


def _round_metrics(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(n, 9).alias(n) for n in _METRIC_COLUMNS])


def metrics_by_split(spark, folder):
    return _round_metrics(E.binary_metrics(judged(spark, folder), "truth", "pred", ["split"]), ["split", "tn", "fp", "fn", "tp"])


def _profiled(spark, folder):
    h = tables.hist(spark, folder).select(
        (F.col("id") % 2).alias("target"), F.col("if_pred").alias("pred_if"), F.col("ae_pred").alias("pred_ae"),
        (F.col("final_label") == "anomaly").alias("heuristic_detected_attack"),
        (F.col("if_norm") > 0.5).cast("int").alias("pred_ensemble"),
        ((F.col("if_norm") > 0.7) | (F.col("ae_pred") == 1)).cast("int").alias("pred_decision_engine"),
        F.when(F.col("id") % 4 < 2, "train").otherwise("test").alias("split"),
        F.when(F.col("id") % 3 == 0, "balanced").otherwise("conservative").alias("profile"),
    )
    return E.metrics_by_module(h, "target", ["split", "profile"])


def metrics_by_module(spark, folder):
    return _round_metrics(_profiled(spark, folder), ["split", "profile", "module"])


def profile_delta(spark, folder):
    out = E.profile_delta(_profiled(spark, folder), ["split"])
    return out.select("split", "module", *[F.round(f"delta_{n}", 9).alias(f"delta_{n}") for n in E.COMPARED])


def split_comparison(spark, folder):
    ranked = E.ranked_candidates(_profiled(spark, folder), "module", ["split", "profile"])
    return ranked.select("split", "profile", "module", "rank")


def threshold_sweep(spark, folder):
    h = tables.hist(spark, folder).withColumn("target", (F.col("if_norm") > 0.6).cast("int"))
    percentiles = [80, 85, 90, 95]
    cuts = dict(zip(percentiles, exact_percentiles(h, "autoencoder_score", percentiles)))
    swept = _round_metrics(E.threshold_sweep(h, "autoencoder_score", "target", cuts), ["percentile", "threshold"])
    return swept.withColumn("threshold", F.round("threshold", 9))


def sweep_best(spark, folder):
    return E.best_candidate(threshold_sweep(spark, folder), "percentile").select("percentile", "recall", "f1_score")


def sweep_ensemble(spark, folder):
    s = scores(spark, folder).withColumn("target", (F.col("score_if_normalized") > 0.6).cast("int"))
    swept = ensemble_sweep(s, "target", sweep_candidates(clipped=False), 1.0)
    return swept.select("candidate", "tn", "fp", "fn", "tp")


def _labelled(spark, folder):
    return tables.table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("target"))


def split_counts(spark, folder):
    out = S.stratified_split(_labelled(spark, folder), "target", ["doc_id"])
    return out.groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))


def balance_under(spark, folder):
    out = S.balance(_labelled(spark, folder), "target", ["doc_id"], "undersample_normal")
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))


def balance_over(spark, folder):
    out = S.balance(_labelled(spark, folder), "target", ["doc_id"], "oversample_attack")
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def row_cap_counts(spark, folder):
    out = S.cap_rows(_labelled(spark, folder), "target", ["doc_id"], 50)
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))


def _scaled(kind):
    def run(spark, folder):
        w = fw_windows(spark, folder).select("window_id", *V.BASE_FEATURES)
        out = fit_scaler(w, V.BASE_FEATURES, kind).transform(w)
        return out.select("window_id", *[F.round(f"scaled_{n}", 6).alias(f"scaled_{n}") for n in V.BASE_FEATURES])

    return run


def recon_error(spark, folder):
    """Reconstruction error of the embedding vectors."""
    e = vector_columns(tables.table(spark, folder, "embeddings"), "embedding", 64)
    names = [f"f{i}" for i in range(64)]
    model = fit_reconstruction(e, names, percentile=90)
    return score_reconstruction(e, model).select("vec_id", "score_ae", "score_ae_log", "score_ae_normalized", "pred_ae")


def forest_fit_score(spark, folder):
    """Isolation forest over the embedding vectors."""
    e = vector_columns(tables.table(spark, folder, "embeddings"), "embedding", 64)
    names = [f"f{i}" for i in range(64)]
    forest = fit_forest(e, names, key_cols=["vec_id"])
    return score_forest(e, forest).select("vec_id", "score_if", "score_if_normalized", "pred_if", "if_confidence")


def scored_fitted(spark, folder):
    """Both detectors fitted with their defaults on the windows they score."""
    w = cut_lineage(fw_windows(spark, folder))
    return score_windows(w, fit_models(w)).select(
        "window_id", "score_if", "score_ae", "ensemble_score", "final_label", "attack_type", "risk_level", "confidence", "decision_source"
    )


def trained_metrics(spark, folder):
    """Split, tune the whole grid under every balance, refit and evaluate on labelled windows."""
    w = cut_lineage(fw_windows(spark, folder)).withColumn("y", (F.col("blocked_count") >= 3).cast("int"))
    model, _, split = train_tuned(w, "y", ["window_id"])
    return evaluate_splits(split, model, "y")


QUERIES = {
    f.__name__: f
    for f in (
        features_13, sanitise, label_extract, label_normalise, dataset_flows, dataset_positional, dataset_targets,
        dq_audit, profile_columns, summary_numbers, score_stats, score_normalise, pct_threshold, confusion,
        metrics_by_split, metrics_by_module, profile_delta, split_comparison, threshold_sweep, sweep_best,
        sweep_ensemble, split_counts, balance_under, balance_over, row_cap_counts, recon_error, forest_fit_score,
        scored_fitted, trained_metrics,
    )
}
QUERIES["scale_std"] = _scaled("standard")
QUERIES["scale_robust"] = _scaled("robust")

_LABEL = "CASE l_partkey % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in LABEL_TEXT.items()) + " END"
_FLOWS = f"""SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(l_suppkey AS DOUBLE) AS connections,
 CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE l_extendedprice END AS bytes, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity ELSE 0 END AS packets,
 l_discount * 100 AS packet_size, CAST(l_partkey % 65536 AS DOUBLE) AS ports, {_LABEL} AS label FROM lineitem"""
_EXACT = "trim(label) IN ('BENIGN','Benign','benign','Normal','normal','NORMAL','0','0.0')"
_M = """round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_score, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 9) AS accuracy,
 round(coalesce(tn / nullif(tn + fp, 0), 0), 9) AS specificity, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS false_positive_rate,
 round(coalesce(tp / nullif(tp + fn, 0), 0) * 0.55 + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * 0.25
  + coalesce(tp / nullif(tp + fp, 0), 0) * 0.10 + coalesce(tn / nullif(tn + fp, 0), 0) * 0.10, 9) AS selection_score"""
_CM = """count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 1 AND p = 1) AS tp"""
_RAW = _M.replace("round(", "(").replace(", 9) AS", ") AS")
_J = "j AS (SELECT doc_id, quality AS t, toxic AS p, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM labels)"
_PRED = {
    "isolation_forest": "if_pred", "autoencoder": "ae_pred", "heuristic": "CASE WHEN final_label = 'anomaly' THEN 1 ELSE 0 END",
    "ensemble": "CASE WHEN if_norm > 0.5 THEN 1 ELSE 0 END", "decision_engine": "CASE WHEN if_norm > 0.7 OR ae_pred = 1 THEN 1 ELSE 0 END",
}
_PROFILED = f"""h AS ({HIST}), u AS (""" + " UNION ALL ".join(
    f"SELECT id % 2 AS t, {p} AS p, CASE WHEN id % 4 < 2 THEN 'train' ELSE 'test' END AS split, CASE WHEN id % 3 = 0 THEN 'balanced' ELSE 'conservative' END AS profile, '{m}' AS module FROM h"
    for m, p in _PRED.items()
) + f"), c AS (SELECT split, profile, module, {_CM} FROM u GROUP BY ALL), m AS (SELECT split, profile, module, {_M} FROM c)"
_DELTA = ", ".join(
    f"round(coalesce(max({n}) FILTER (profile = 'balanced'), 0) - coalesce(max({n}) FILTER (profile = 'conservative'), 0), 9) AS delta_{n}"
    for n in E.COMPARED
)
_SWEEP = f"""h AS ({HIST}), o AS (SELECT CAST(unnest([80, 85, 90, 95]) AS DOUBLE) AS percentile, unnest(quantile_cont(autoencoder_score, [0.80, 0.85, 0.90, 0.95])) AS threshold FROM h),
x AS (SELECT percentile, threshold, CASE WHEN if_norm > 0.6 THEN 1 ELSE 0 END AS t, CASE WHEN autoencoder_score > threshold THEN 1 ELSE 0 END AS p FROM h, o),
c AS (SELECT percentile, threshold, {_CM} FROM x GROUP BY ALL), m AS (SELECT percentile, round(threshold, 9) AS threshold, {_M} FROM c)"""
_CANDIDATES = sweep_candidates(clipped=False)


def _sweep_sql() -> str:
    head = _ensemble_sql("balanced").rsplit("e4 AS", 1)[0].rstrip().rstrip(",")
    base = _CANDIDATES[0]
    rows = ", ".join(
        f"({i}, CAST({c.weights()[0]} AS DOUBLE), CAST({c.weights()[1]} AS DOUBLE), CAST({c.support_threshold()} AS DOUBLE))"
        for i, c in enumerate(_CANDIDATES)
    )
    return f"""WITH {head}, o AS (SELECT * FROM (VALUES {rows}) v(candidate, wi, wa, th)),
y AS (SELECT *, greatest(0, least(1, risk * wa + alert * wi + agree * {base.agreement} + boost - conflict)) AS ens FROM e3, o),
x AS (SELECT candidate, CASE WHEN score_if_normalized > 0.6 THEN 1 ELSE 0 END AS t,
 CASE WHEN ens >= th AND (band <> 'low' OR alert >= {base.strong}) THEN 1 ELSE 0 END AS p FROM y)
SELECT candidate, {_CM} FROM x GROUP BY candidate"""


def _scale_sql(kind: str) -> str:
    if kind == "standard":
        one = "round((w.{0} - avg(w.{0}) OVER ()) / CASE WHEN stddev_pop(w.{0}) OVER () = 0 THEN 1 ELSE stddev_pop(w.{0}) OVER () END, 6) AS scaled_{0}"
        return f"WITH w AS ({MODES_SQL}) SELECT window_id, " + ", ".join(one.format(n) for n in V.BASE_FEATURES) + " FROM w"
    stats = ", ".join(
        f"quantile_cont({n}, 0.5) AS m_{n}, quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) AS i_{n}" for n in V.BASE_FEATURES
    )
    cells = ", ".join(f"round(({n} - m_{n}) / CASE WHEN i_{n} = 0 THEN 1 ELSE i_{n} END, 6) AS scaled_{n}" for n in V.BASE_FEATURES)
    return f"WITH w AS ({MODES_SQL}), q AS (SELECT {stats} FROM w) SELECT window_id, {cells} FROM w, q"


_SIZES = """n AS (SELECT toxic AS target, count(*) AS c, (SELECT count(*) FROM labels) AS total FROM labels GROUP BY toxic)"""
_SPLIT = f"""WITH {_SIZES},
a AS (SELECT *, CAST(ceil(round(total * 0.3, 9)) AS BIGINT) AS held FROM n),
b AS (SELECT *, CAST(floor(held * c / total) AS BIGINT) AS f0, held * c / total - floor(held * c / total) AS frac FROM a),
d AS (SELECT *, f0 + CASE WHEN row_number() OVER (ORDER BY frac DESC, target) <= held - sum(f0) OVER () THEN 1 ELSE 0 END AS hc FROM b),
g AS (SELECT *, CAST(ceil(round(sum(hc) OVER () * 0.5, 9)) AS BIGINT) AS tt, sum(hc) OVER () AS hs FROM d),
k AS (SELECT *, CAST(floor(tt * hc / hs) AS BIGINT) AS t0, tt * hc / hs - floor(tt * hc / hs) AS tf FROM g),
z AS (SELECT *, t0 + CASE WHEN row_number() OVER (ORDER BY tf DESC, target) <= tt - sum(t0) OVER () THEN 1 ELSE 0 END AS tc FROM k)
SELECT 'train' AS split, target, c - hc AS n FROM z UNION ALL SELECT 'validation', target, hc - tc FROM z WHERE hc > tc UNION ALL SELECT 'test', target, tc FROM z WHERE tc > 0"""
ORACLES = {
    "features_13": f"""WITH f AS ({_FLOWS}) SELECT count(*) AS n, round(sum(connections), 2) AS connections, round(sum(bytes), 2) AS bytes, round(sum(packets), 2) AS packets,
 round(sum(packet_size), 2) AS packet_size, round(sum(ports), 2) AS ports, round(sum(ln(1 + ports)), 2) AS log1p_ports,
 round(sum(coalesce(packets / nullif(connections, 0), 0)), 2) AS packets_per_connection FROM f""",
    "sanitise": f"SELECT row_id, bytes AS b, packets AS p FROM ({_FLOWS})",
    "label_extract": f"""SELECT row_id, CASE WHEN upper(trim(label)) IN ('BENIGN','NORMAL','NORMAL_TRAFFIC','NORMAL TRAFFIC','0') THEN 0 ELSE 1 END AS y FROM ({_FLOWS})""",
    "label_normalise": f"SELECT row_id, trim(label) AS label, CASE WHEN {_EXACT} THEN 0 ELSE 1 END AS target FROM ({_FLOWS})",
    "dataset_flows": f"SELECT connections, bytes, packets, packet_size, ports, label FROM ({_FLOWS})",
    "dataset_positional": """SELECT CAST(l_suppkey AS DOUBLE) AS connections, l_extendedprice AS bytes, l_quantity AS packets, l_extendedprice AS packet_size,
 CAST(l_partkey AS DOUBLE) AS ports, l_returnflag AS label FROM lineitem""",
    "dataset_targets": f"""SELECT trim(label) AS label, count(*) FILTER ({_EXACT}) AS normal, count(*) FILTER (NOT {_EXACT}) AS attack, count(*) AS total FROM ({_FLOWS}) GROUP BY trim(label)""",
    "dq_audit": f"""WITH h AS ({HIST}) SELECT 'a' AS feature, count(*) FILTER (id % 7 = 0) AS nulls, 0 AS negatives, 0 AS infinites FROM h
 UNION ALL SELECT 'b', 0, count(*) FILTER (id % 5 <> 0 AND if_norm - 0.5 < 0), count(*) FILTER (id % 5 = 0) FROM h UNION ALL SELECT 'c', 0, 0, 0""",
    "profile_columns": f"""WITH h AS ({HIST}),
 r AS (SELECT risk_level AS v, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, v LIMIT 1), i AS (SELECT CAST(if_pred AS VARCHAR) AS v, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, v LIMIT 1),
 a AS (SELECT attack_type AS v, count(*) AS n FROM h WHERE attack_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)
SELECT 'risk_level' AS "column", 'categorical' AS kind, (SELECT count(DISTINCT risk_level) FROM h) AS unique_values, v AS top_value, n AS top_n, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean FROM r
 UNION ALL SELECT 'attack_type', 'categorical', (SELECT count(DISTINCT attack_type) FROM h), v, n, NULL, NULL, NULL FROM a
 UNION ALL SELECT 'if_pred', 'categorical_numeric', (SELECT count(DISTINCT if_pred) FROM h), v, n, NULL, NULL, NULL FROM i
 UNION ALL SELECT 'if_norm', 'numeric', NULL, NULL, NULL, round(min(if_norm), 6), round(max(if_norm), 6), round(avg(if_norm), 6) FROM h
 UNION ALL SELECT 'id_mod', 'numeric', NULL, NULL, NULL, min(id % 50), max(id % 50), round(avg(id % 50), 6) FROM h""",
    "summary_numbers": f"""WITH h AS ({HIST}) SELECT 'ensemble_score' AS "column", round(min(ensemble_score), 9) AS min, round(max(ensemble_score), 9) AS max, round(avg(ensemble_score), 9) AS mean FROM h
 UNION ALL SELECT 'if_norm', round(min(if_norm), 9), round(max(if_norm), 9), round(avg(if_norm), 9) FROM h UNION ALL SELECT 'if_pred', min(if_pred), max(if_pred), round(avg(if_pred), 9) FROM h""",
    "score_stats": f"""WITH h AS ({HIST}) SELECT round(min(autoencoder_score), 9) AS score_min, round(max(autoencoder_score), 9) AS score_max, round(avg(autoencoder_score), 9) AS score_mean,
 round(stddev_pop(autoencoder_score), 9) AS score_std FROM h""",
    "score_normalise": f"""WITH h AS ({HIST}), x AS (SELECT min(autoencoder_score) AS lo, max(autoencoder_score) AS hi FROM h) SELECT id, round((autoencoder_score - lo) / (hi - lo), 9) AS normalised FROM h, x""",
    "pct_threshold": f"""WITH h AS ({HIST}), q AS (SELECT unnest([80, 85, 90, 95]) AS percentile, unnest(quantile_cont(autoencoder_score, [0.80, 0.85, 0.90, 0.95])) AS threshold FROM h)
SELECT percentile, round(threshold, 9) AS threshold, (SELECT count(*) FROM h WHERE autoencoder_score > q.threshold) AS over FROM q""",
    "confusion": f"WITH {_J} SELECT {_CM} FROM j",
    "metrics_by_split": f"WITH {_J}, c AS (SELECT split, {_CM} FROM j GROUP BY split) SELECT split, tn, fp, fn, tp, {_M} FROM c",
    "metrics_by_module": f"WITH {_PROFILED} SELECT * FROM m",
    "profile_delta": f"WITH {_PROFILED}, r AS (SELECT split, profile, module, {_RAW} FROM c) SELECT split, module, {_DELTA} FROM r WHERE module IN ('ensemble', 'decision_engine') GROUP BY split, module",
    "split_comparison": f"""WITH {_PROFILED} SELECT split, profile, module,
 row_number() OVER (PARTITION BY split, profile ORDER BY recall DESC, f1_score DESC, false_positive_rate, precision DESC, module) AS rank FROM m""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM m",
    "sweep_best": f"WITH {_SWEEP} SELECT percentile, recall, f1_score FROM m ORDER BY recall DESC, f1_score DESC, false_positive_rate, precision DESC, percentile LIMIT 1",
    "sweep_ensemble": _sweep_sql(),
    "split_counts": _SPLIT,
    "balance_under": f"WITH {_SIZES} SELECT target, min(c) OVER () AS n, min(c) OVER () AS ids FROM n",
    "balance_over": f"WITH {_SIZES} SELECT target, CASE WHEN c = min(c) OVER () THEN least(max(c) OVER (), 2 * c) ELSE c END AS n FROM n",
    "row_cap_counts": f"WITH {_SIZES} SELECT target, greatest(1, CAST(round_even(50 * c / total, 0) AS BIGINT)) AS n, greatest(1, CAST(round_even(50 * c / total, 0) AS BIGINT)) AS ids FROM n",
    "scale_std": _scale_sql("standard"),
    "scale_robust": _scale_sql("robust"),
}
