"""History queries over scored windows."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.catalog import tables
from flowguard.catalog.tables import HIST
from flowguard.functions.display import label
from flowguard.operators import history as H
from flowguard.operators.distributions import chart_rows, distributions, pair_distribution
from flowguard.operators.reports import scenario_summary
from flowguard.operators.pages import ordering, read_page, seek_page, write_ranges
from flowguard.operators.search import find_rows, write_index
from flowguard.operators.single import attach_row
from flowguard.session import cut_lineage, ensure_checkpoint_dir


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """History rows with nested payloads and the optional columns."""
    h = tables.hist(spark, folder)
    strong = (F.col("ensemble_score") >= 0.05) & (F.col("autoencoder_score") >= 1) & (F.col("if_norm") >= 0.82)
    return h.withColumns(
        {
            "status": F.when(F.col("id") % 100 != 0, "success"),
            "window_id": F.concat(F.lit("w-"), F.col("id").cast("string")),
            "window_uid": F.concat(F.lit("u-"), (F.col("id") % 5000).cast("string")),
            "local_log_path": F.concat(F.lit("/log/"), (F.col("id") % 3).cast("string")),
            "window_start": F.col("created_at"),
            "confidence": F.col("if_norm"),
            "isolation_score": F.col("if_norm") - 0.5,
            "decision_source": F.when(F.col("final_label") == "anomaly", "heuristic_signature").otherwise("safe_negative"),
            "features": F.struct((F.col("id") % 40).cast("double").alias("connections"), F.col("if_norm").alias("packets")),
            "metadata": F.struct(
                F.when(F.col("id") % 4 != 0, F.concat(F.lit("10.0.0."), (F.col("id") % 8).cast("string"))).alias("src_ip"),
                F.concat(F.lit("192.168.1."), (F.col("id") % 5).cast("string")).alias("destination_ip_sample"),
                F.lit("22,80").alias("common_destination_ports"),
                F.when(F.col("id") % 2 == 0, "tcp").alias("protocol"),
            ),
            "raw": F.struct(
                F.lit("10.9.9.9").alias("src_ip"), F.lit("udp").alias("protocol"), F.lit("block").alias("action"),
                F.concat(F.lit("why "), "final_label").alias("explanation"),
            ),
            "model_outputs": F.struct(
                F.struct(
                    (F.col("ensemble_score") >= 0.05).alias("enabled"),
                    F.when(strong, "sim").otherwise("não").alias("conservative"),
                ).alias("ai_support")
            ),
        }
    )


_SCALARS = ["id", "created_at", "execution_id", "final_label", "attack_type", "risk_level", "ensemble_score"]
FILTERS = {
    "final_label": "anomaly", "risk_level": "high", "attack_type": "", "date_from": "2024-01-03T00:00:00Z",
    "date_to": "2024-01-20", "ai_support": "sim",
}


def hist_filter(spark, folder):
    return H.history_filter(stored(spark, folder), FILTERS).select(*_SCALARS)


def hist_no_support(spark, folder):
    return H.history_filter(stored(spark, folder), {"ai_support": "não"}).select(*_SCALARS)


def hist_page(spark, folder):
    return H.history_windows(stored(spark, folder), None, limit=40, offset=25).select(*_SCALARS)


def hist_page_total(spark, folder):
    return H.page_with_total(H.history_filter(stored(spark, folder), FILTERS), 1000, -3).select("id", "total")


def hist_alerts(spark, folder):
    return H.history_alerts(stored(spark, folder), {"attack_type": "port_scan"}, limit=30).select(*_SCALARS)


def live_page(spark, folder):
    return H.live_windows(stored(spark, folder), 20, 5).select(*_SCALARS)


def hist_lookup(spark, folder):
    return H.by_key(stored(spark, folder), "id", 77).select(*_SCALARS)


def hist_text_filter(spark, folder):
    rows = H.compact_windows(stored(spark, folder))
    return H.text_filter(
        rows, {"src_ip": "0.0.2", "protocol": "TCP", "action": "BLÓCK"}, only_anomalies=True,
        date_from="2024-01-02", date_to="2024-01-28T12:00:00",
    ).select("id", "src_ip", "protocol")


def hist_search(spark, folder):
    return H.search(H.compact_windows(stored(spark, folder)), "Exec-7 ").select("id", "execution_id")


def hist_search_features(spark, folder):
    return H.search(H.compact_windows(stored(spark, folder)), " 39 0.39").select("id")


def _place(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def search_windows(spark, folder):
    """F17 by trigrams over the windows."""
    rows, path = H.compact_windows(stored(spark, folder)), _place(spark, "search")
    write_index(rows, path, "id", H.WINDOW_SEARCH)
    return find_rows(rows, path, "id", "ÊXEC-7 ").select("id", "execution_id")


def search_executions(spark, folder):
    """F17 by trigrams over the executions."""
    rows, path = H.executions(stored(spark, folder)), _place(spark, "search")
    rows = cut_lineage(rows)
    write_index(rows, path, "execution_id", H.EXECUTION_SEARCH)
    return find_rows(rows, path, "execution_id", "xec-4").select("execution_id", "total_windows")


def search_analyses(spark, folder):
    """F17 by trigrams over the analyses, with a query that needs its last letter checked."""
    rows = tables.table(spark, folder, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.concat(F.lit("Arquivo-"), F.col("o_orderkey").cast("string"), F.lit(".log")).alias("filename"), F.col("o_orderpriority").alias("predominant_attack_type"))
    path = _place(spark, "search")
    write_index(rows, path, "analysis_id", H.ANALYSIS_SEARCH)
    return find_rows(rows, path, "analysis_id", "árquivo-11").select("analysis_id", "filename")


def page_by_seek(spark, folder):
    """The page after a given row."""
    rows = stored(spark, folder).withColumn("t", H.history_time())
    last = rows.orderBy(*ordering(["t", "id"])).offset(64).limit(1).select("t", "id").first()
    return seek_page(rows, ["t", "id"], tuple(last), 40).select(*_SCALARS)


def page_by_number(spark, folder):
    """A late page from stored ranges."""
    path = _place(spark, "pages")
    write_ranges(stored(spark, folder).withColumn("t", H.history_time()), path, ["t", "id"])
    return read_page(spark, path, ["t", "id"], 50, 850).select(*_SCALARS)


def page_of_analyses(spark, folder):
    """Analyses by creation."""
    return seek_page(analyses(spark, folder), ["created_at", "analysis_id"], None, 500).select("analysis_id", "created_at")


def first_results(spark, folder):
    """The first ten results of a scored run, in window order."""
    rows = stored(spark, folder)
    return rows.orderBy("window_start", "id").limit(10).select("id", "window_id", "final_label")


def hist_compact(spark, folder):
    return H.compact_windows(stored(spark, folder)).select(
        "id", "decision_reason", "src_ip", "dst_ip", "dst_port", "protocol", "action", "ai_support",
        F.col("scores.ensemble").alias("ensemble"),
    )


def _key(column: str, key: str):
    return F.coalesce(F.try_element_at(F.col(column), F.lit(key)), F.lit(0)).alias(f"{column.split('_')[0]}_{key}")


def hist_executions(spark, folder):
    return H.executions(stored(spark, folder), {"date_from": "2024-01-02"}).select(
        "execution_id", "first_seen_at", "last_seen_at", "total_windows", "total_anomalies", "ai_support_count",
        "ai_support_conservative_count", "local_log_path",
        _key("final_label_distribution", "anomaly"), _key("attack_type_distribution", "unknown"),
        _key("attack_type_distribution", "port_scan"), _key("risk_level_distribution", "high"),
        _key("status_distribution", "success"), _key("status_distribution", "unknown"),
    )


def analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Orders stand for analyses, their lines for results."""
    return tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("analysis_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderstatus").alias("final_status"),
        F.col("o_orderpriority").alias("predominant_attack_type"),
        F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("predominant_risk_level"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("window_id")
    )


def hist_summary(spark, folder):
    s = H.history_summary(stored(spark, folder), analyses(spark, folder), results(spark, folder), {"date_from": "2024-01-02"})
    return s.select(
        "total_windows", "total_alerts", "total_executions", "ai_support_count", "ai_support_conservative_count",
        "total_analyses", "total_results",
        F.col("latest_window.id").alias("latest_window"), F.col("latest_alert.id").alias("latest_alert"),
        F.col("latest_analysis.created_at").alias("latest_analysis"),
        _key("attack_type_distribution", "unknown"), _key("risk_level_distribution", "medium"),
        _key("final_status_distribution", "F"),
    )


def entity_totals(spark, folder):
    return H.entity_totals(stored(spark, folder), analyses(spark, folder), results(spark, folder))


def dashboard(spark, folder):
    totals, recent = H.dashboard(stored(spark, folder), 5)
    newest = recent.agg(F.max("id").alias("newest_id"), F.count("id").alias("recent"))
    counts = totals.select(
        "total_windows", "total_alerts", "ai_support_count", "ai_support_conservative_count",
        _key("attack_type_distribution", "brute_force"), _key("risk_level_distribution", "low"),
    )
    return attach_row(counts, newest)


def timeline(spark, folder):
    return H.timeline(stored(spark, folder)).select("id", "is_anomaly", "score")


def analyses_join(spark, folder):
    return H.analyses_with_counts(analyses(spark, folder), results(spark, folder)).select(
        "analysis_id", "created_at", "n_results"
    )


def analysis_results(spark, folder):
    return H.results_of(results(spark, folder), 7, limit=5).select("analysis_id", "id", "window_id")


def new_windows(spark, folder):
    """Rows whose uid is not among those stored; one row per uid."""
    rows = stored(spark, folder)
    known = rows.where(F.col("id") % 3 == 0).select("window_uid").distinct()
    return rows.select("window_uid").dropDuplicates(["window_uid"]).join(known, "window_uid", "left_anti")


def top_distribution(spark, folder):
    return pair_distribution(stored(spark, folder), "attack_type", "risk_level")


def label_distributions(spark, folder):
    return distributions(stored(spark, folder), ["final_label", "attack_type", "risk_level", "status"])


def chart_items(spark, folder):
    return chart_rows(distributions(stored(spark, folder), ["attack_type", "risk_level"]))


def export_rows(spark, folder):
    rows = H.compact_windows(stored(spark, folder))
    wide = H.export_rows(rows)
    names = dict(V.EXPORT_COLUMNS)
    return wide.select(*[F.col(f"`{h}`").alias(n) for h, n in names.items() if n not in ("window_end",)])


def display_labels(spark, folder):
    kind = tables.table(spark, folder, "events").select(F.concat(F.lit("my_"), "event_type").alias("t")).distinct()
    both = stored(spark, folder).select(F.col("attack_type").alias("t")).distinct().unionByName(kind)
    return both.select("t", label(F.col("t"), "attack_type").alias("shown"), label(F.col("t"), "final_label").alias("final"))


def window_durations(spark, folder):
    li = tables.table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("a"),
        F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(F.col("event_id") % 300).cast("decimal(18,6)") / 4)).alias("b"),
    )
    return li.select("event_id", H.window_duration(F.col("a"), F.col("b")).alias("seconds"))


def window_uids(spark, folder):
    rows = stored(spark, folder).select(
        "id", "window_id", F.lit("a").alias("window_start"), F.lit("b").alias("window_end"), "local_log_path"
    )
    return rows.select("id", H.window_uid(F.col("local_log_path")).alias("window_uid"))


def classification(spark, folder):
    return H.classification(stored(spark, folder))


def summary_counts(spark, folder):
    return H.summary_counts(stored(spark, folder))


def result_columns(spark, folder):
    return H.result_rows(stored(spark, folder)).select("window_id", "final_label", "attack_type", "confidence", "ensemble_score")


def module_status(spark, folder):
    rows = stored(spark, folder).withColumns(
        {"pred_if": F.col("if_pred"), "pred_ae": F.col("ae_pred"), "pred_ensemble": F.lit(None).cast("int"),
         "heuristic_detected_attack": F.col("final_label") == "anomaly"}
    )
    return H.module_cards(rows).select(
        "id", "autoencoder_status", "isolation_forest_status", "heuristic_status", "ensemble_status", "decision_status", "decision_value"
    )


def scenarios(spark, folder):
    names = F.when(F.col("id") % 4 == 0, "normal_firewall").when(F.col("id") % 4 == 1, "port_scan").otherwise("brute_force")
    rows = stored(spark, folder).withColumns(
        {"scenario": names, "is_anomaly": F.col("final_label") == "anomaly", "source_ip": F.col("id").cast("string")}
    ).where((F.col("scenario") != "port_scan") | (F.col("attack_type") == "port_scan"))
    lines = rows.select("scenario")
    return scenario_summary(rows, lines).select(
        "scenario", "windows", "parsed_lines", "dominant_final_label", "dominant_attack_type", "dominant_risk_level",
        "observation", F.coalesce(F.try_element_at("is_anomaly_counts", F.lit("true")), F.lit(0)).alias("anomalies"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        hist_filter, hist_no_support, hist_page, hist_page_total, hist_alerts, live_page, hist_lookup, hist_text_filter,
        hist_search, hist_search_features, hist_compact, hist_executions, hist_summary, entity_totals, dashboard,
        timeline, analyses_join, analysis_results, new_windows, top_distribution, label_distributions, chart_items,
        export_rows, display_labels, window_durations, window_uids, classification, summary_counts, result_columns,
        module_status, scenarios, search_windows, search_executions, search_analyses, page_by_seek, page_by_number, page_of_analyses, first_results,
    )
}

_H = f"""
WITH h AS ({HIST}),
s AS (SELECT *, coalesce(window_timestamp, created_at) AS t, ensemble_score >= 0.05 AS ai,
  ensemble_score >= 0.05 AND autoencoder_score >= 1 AND if_norm >= 0.82 AS strong,
  CASE WHEN id % 100 <> 0 THEN 'success' END AS status, concat('/log/', id % 3) AS local_log_path,
  CASE WHEN id % 4 <> 0 THEN concat('10.0.0.', id % 8) ELSE '10.9.9.9' END AS src_ip,
  CASE WHEN id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol FROM h)
"""
_COLS = "id, created_at, execution_id, final_label, attack_type, risk_level, ensemble_score"
_WANTED = """final_label = 'anomaly' AND risk_level = 'high' AND t >= TIMESTAMP '2024-01-03' AND t <= TIMESTAMP '2024-01-20' AND ai"""
_AN = """an AS (SELECT o_orderkey AS analysis_id, o_orderdate AS created_at, o_orderstatus AS final_status FROM orders)"""


def _labels(column: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    words = f"array_to_string(list_transform(string_split(coalesce({column}, 'unknown'), '_'), lambda w: concat(upper(w[1]), w[2:])), ' ')"
    return f"CASE coalesce({column}, 'unknown') {cases} ELSE {words} END"


_EXEC = """SELECT execution_id, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at, count(*) AS total_windows,
 count(*) FILTER (final_label = 'anomaly') AS total_anomalies, count(*) FILTER (ai) AS ai_support_count,
 count(*) FILTER (strong) AS ai_support_conservative_count, arg_max(local_log_path, id) AS local_log_path,
 count(*) FILTER (final_label = 'anomaly') AS final_anomaly, count(*) FILTER (attack_type IS NULL) AS attack_unknown,
 count(*) FILTER (attack_type = 'port_scan') AS attack_port_scan, count(*) FILTER (risk_level = 'high') AS risk_high,
 count(*) FILTER (status = 'success') AS status_success, count(*) FILTER (status IS NULL) AS status_unknown
 FROM s WHERE t >= TIMESTAMP '2024-01-02' GROUP BY execution_id"""
_LONG = """SELECT 'final_label' AS dimension, final_label AS value, count(*) AS n FROM s GROUP BY 2
 UNION ALL SELECT 'attack_type', coalesce(attack_type, 'unknown'), count(*) FROM s GROUP BY 2
 UNION ALL SELECT 'risk_level', risk_level, count(*) FROM s GROUP BY 2
 UNION ALL SELECT 'status', coalesce(status, 'unknown'), count(*) FROM s GROUP BY 2"""

ORACLES = {
    "hist_filter": f"{_H} SELECT {_COLS} FROM s WHERE {_WANTED}",
    "hist_no_support": f"{_H} SELECT {_COLS} FROM s WHERE NOT ai",
    "hist_page": f"{_H} SELECT {_COLS} FROM s ORDER BY t DESC, id DESC LIMIT 40 OFFSET 25",
    "hist_page_total": f"{_H} SELECT id, (SELECT count(*) FROM s WHERE {_WANTED}) AS total FROM s WHERE {_WANTED} ORDER BY t DESC, id DESC LIMIT 500",
    "hist_alerts": f"{_H} SELECT {_COLS} FROM s WHERE final_label = 'anomaly' AND attack_type = 'port_scan' ORDER BY t DESC, id DESC LIMIT 30",
    "live_page": f"{_H} SELECT {_COLS} FROM s ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5",
    "hist_lookup": f"{_H} SELECT {_COLS} FROM s WHERE id = 77",
    "hist_text_filter": f"""{_H} SELECT id, src_ip, protocol FROM s WHERE final_label = 'anomaly' AND contains(src_ip, '0.0.2')
 AND protocol = 'tcp' AND created_at >= TIMESTAMP '2024-01-02' AND created_at <= TIMESTAMP '2024-01-28 12:00:00'""",
    "hist_search": f"{_H} SELECT id, execution_id FROM s WHERE execution_id LIKE '%exec-7'",
    "search_windows": f"{_H} SELECT id, execution_id FROM s WHERE execution_id LIKE '%exec-7'",
    "search_executions": f"{_H} SELECT execution_id, count(*) AS total_windows FROM s WHERE execution_id LIKE '%xec-4%' GROUP BY 1",
    "search_analyses": "SELECT o_orderkey AS analysis_id, concat('Arquivo-', o_orderkey, '.log') AS filename FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '11%'",
    "page_by_seek": f"{_H} SELECT {_COLS} FROM s ORDER BY t DESC, id DESC LIMIT 40 OFFSET 65",
    "page_by_number": f"{_H} SELECT {_COLS} FROM s ORDER BY t DESC, id DESC LIMIT 50 OFFSET 850",
    "page_of_analyses": "SELECT o_orderkey AS analysis_id, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, analysis_id DESC LIMIT 500",
    "first_results": f"{_H} SELECT id, concat('w-', id) AS window_id, final_label FROM s ORDER BY created_at, id LIMIT 10",
    "hist_search_features": f"{_H} SELECT id FROM s WHERE id % 40 = 39 AND if_norm = CAST(0.39 AS DOUBLE)",
    "hist_compact": f"""{_H} SELECT id, concat('why ', final_label) AS decision_reason, src_ip, concat('192.168.1.', id % 5) AS dst_ip, '22,80' AS dst_port,
 protocol, 'block' AS action, ai AS ai_support, ensemble_score AS ensemble FROM s""",
    "hist_executions": f"{_H} {_EXEC}",
    "hist_summary": f"""{_H}, f AS (SELECT * FROM s WHERE t >= TIMESTAMP '2024-01-02'), {_AN}
SELECT count(*) AS total_windows, count(*) FILTER (final_label = 'anomaly') AS total_alerts, count(DISTINCT execution_id) AS total_executions,
 count(*) FILTER (ai) AS ai_support_count, count(*) FILTER (strong) AS ai_support_conservative_count,
 (SELECT count(*) FROM orders) AS total_analyses, (SELECT count(*) FROM lineitem) AS total_results,
 (SELECT id FROM f ORDER BY t DESC, id DESC LIMIT 1) AS latest_window,
 (SELECT id FROM f WHERE final_label = 'anomaly' ORDER BY t DESC, id DESC LIMIT 1) AS latest_alert,
 (SELECT max(created_at) FROM an) AS latest_analysis,
 count(*) FILTER (attack_type IS NULL) AS attack_unknown, count(*) FILTER (risk_level = 'medium') AS risk_medium,
 (SELECT count(*) FROM an WHERE final_status = 'F') AS final_F FROM f""",
    "entity_totals": f"""{_H} SELECT count(*) AS total_windows, count(*) FILTER (final_label = 'anomaly') AS total_alerts, count(DISTINCT execution_id) AS total_executions,
 (SELECT count(*) FROM orders) AS total_analyses, (SELECT count(*) FROM lineitem) AS total_results FROM s""",
    "dashboard": f"""{_H} SELECT count(*) AS total_windows, count(*) FILTER (final_label = 'anomaly') AS total_alerts, count(*) FILTER (ai) AS ai_support_count,
 count(*) FILTER (strong) AS ai_support_conservative_count, count(*) FILTER (attack_type = 'brute_force') AS attack_brute_force,
 count(*) FILTER (risk_level = 'low') AS risk_low, (SELECT max(id) FROM (SELECT id FROM s ORDER BY created_at DESC, id DESC LIMIT 5)) AS newest_id, 5 AS recent FROM s""",
    "timeline": f"""{_H} SELECT id, final_label = 'anomaly' AS is_anomaly, greatest(ensemble_score, CASE WHEN final_label = 'anomaly' THEN 0.75 ELSE 0.18 END) AS score
 FROM s ORDER BY t DESC, id DESC LIMIT 12""",
    "analyses_join": """SELECT o_orderkey AS analysis_id, o_orderdate AS created_at, count(l_orderkey) AS n_results
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "analysis_results": "SELECT l_orderkey AS analysis_id, l_linenumber AS id, l_partkey AS window_id FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber LIMIT 5",
    "new_windows": f"""{_H} SELECT DISTINCT concat('u-', id % 5000) AS window_uid FROM s
 WHERE concat('u-', id % 5000) NOT IN (SELECT concat('u-', id % 5000) FROM s WHERE id % 3 = 0)""",
    "top_distribution": f"{_H} SELECT attack_type, risk_level, count(*) AS n FROM s GROUP BY 1, 2 ORDER BY n DESC",
    "label_distributions": f"{_H} {_LONG}",
    "chart_items": f"""{_H}, l AS (SELECT * FROM ({_LONG}) WHERE dimension IN ('attack_type', 'risk_level'))
SELECT dimension, value, n, CAST(greatest(4, round(n / greatest(max(n) OVER (PARTITION BY dimension), 1) * 100)) AS INT) AS bar_width,
 row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM l""",
    "export_rows": f"""{_H} SELECT id, concat('w-', id) AS window_id, execution_id, created_at AS window_start,
 {_labels('final_label', V.FINAL_LABELS)} AS final_label, {_labels('attack_type', V.ATTACK_LABELS)} AS attack_type,
 {_labels('risk_level', V.RISK_LABELS)} AS risk_level,
 CASE WHEN final_label = 'anomaly' THEN 'Heurística' ELSE 'Sistema' END AS decision_source, if_norm AS confidence,
 CASE WHEN ai THEN 'Sim' ELSE 'Não' END AS ai_support, ensemble_score, autoencoder_score, if_norm - 0.5 AS isolation_score,
 src_ip, concat('192.168.1.', id % 5) AS dst_ip, '22,80' AS dst_port, protocol, 'block' AS action FROM s""",
    "display_labels": f"""{_H}, k AS (SELECT DISTINCT attack_type AS t FROM s UNION ALL SELECT DISTINCT concat('my_', event_type) FROM events)
SELECT t, {_labels('t', V.ATTACK_LABELS)} AS shown, {_labels('t', V.FINAL_LABELS)} AS final FROM k""",
    "window_durations": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 60 ELSE greatest(1, CAST(round((event_id % 300) / 4) AS BIGINT)) END AS seconds FROM events""",
    "window_uids": f"""{_H} SELECT id, sha256(concat('{{"local_path":"', local_log_path, '","window_id":"w-', id, '","window_start":"a","window_end":"b"}}')) AS window_uid FROM s""",
    "classification": f"""{_H} SELECT 'anomaly' AS final_status,
 (SELECT attack_type FROM s WHERE final_label = 'anomaly' AND attack_type <> 'normal' GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 1) AS predominant_attack_type,
 (SELECT risk_level FROM s WHERE final_label = 'anomaly' GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 1) AS predominant_risk_level,
 round(avg(if_norm), 4) AS confidence_avg FROM s""",
    "summary_counts": f"""{_H} SELECT count(*) FILTER (final_label = 'normal') AS normal, count(*) FILTER (final_label = 'anomaly') AS anomaly,
 count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low FROM s""",
    "result_columns": f"{_H} SELECT concat('w-', id) AS window_id, final_label, attack_type, if_norm AS confidence, ensemble_score FROM s",
    "module_status": f"""{_H} SELECT id, CASE WHEN ae_pred = 1 THEN 'Detectou' ELSE 'Normal' END AS autoencoder_status,
 CASE WHEN if_pred = 1 THEN 'Detectou' ELSE 'Normal' END AS isolation_forest_status,
 CASE WHEN final_label = 'anomaly' THEN 'Disparou' ELSE 'Neutra' END AS heuristic_status, 'Sem sinal' AS ensemble_status,
 {_labels('final_label', V.FINAL_LABELS)} AS decision_status, {_labels('attack_type', V.ATTACK_LABELS)} AS decision_value FROM s""",
    "scenarios": f"""{_H}, c AS (SELECT *, CASE id % 4 WHEN 0 THEN 'normal_firewall' WHEN 1 THEN 'port_scan' ELSE 'brute_force' END AS scenario FROM s),
k AS (SELECT * FROM c WHERE scenario <> 'port_scan' OR attack_type = 'port_scan'),
d AS (SELECT scenario, count(*) AS windows, count(*) FILTER (final_label = 'anomaly') AS anomalies,
  arg_max(final_label, n1) AS dl, arg_max(attack_type, n2) AS da, arg_max(risk_level, n3) AS dr FROM
  (SELECT *, count(*) OVER (PARTITION BY scenario, final_label) AS n1, count(*) OVER (PARTITION BY scenario, attack_type) AS n2,
   count(*) OVER (PARTITION BY scenario, risk_level) AS n3 FROM k) GROUP BY scenario)
SELECT scenario, windows, windows AS parsed_lines, dl AS dominant_final_label, da AS dominant_attack_type, dr AS dominant_risk_level, anomalies,
 CASE WHEN scenario = 'normal_firewall' AND dl = 'normal' THEN '{V.OBSERVATIONS["calm"]}' WHEN scenario = 'normal_firewall' THEN '{V.OBSERVATIONS["noisy"]}'
  WHEN da <> 'normal' THEN concat('Cenario preservou o tipo ', da, ' com risco dominante ', dr, '.') ELSE '{V.OBSERVATIONS["lost"]}' END AS observation FROM d""",
}
