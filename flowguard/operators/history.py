"""Queries over scored windows kept as history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard import vocabulary as V
from flowguard.functions.display import contains_text, label, search_text
from flowguard.functions.scalar import bool_filter, parse_flag
from flowguard.operators.distributions import distribution_maps, distributions, key_text
from flowguard.operators.single import attach_row

LABEL_COLUMNS = ["final_label", "attack_type", "risk_level"]
WINDOW_SEARCH = [
    "id", "window_id", "execution_id", "final_label", "attack_type", "risk_level", "decision_source",
    "src_ip", "dst_ip", "dst_port", "protocol", "action", "features", "metadata",
]
EXECUTION_SEARCH = [
    "execution_id", "total_windows", "total_anomalies", "final_label_distribution",
    "attack_type_distribution", "risk_level_distribution", "local_log_path", "remote_path",
]
ANALYSIS_SEARCH = [
    "analysis_id", "filename", "final_status", "predominant_attack_type", "predominant_risk_level", "total_windows",
]


def history_time() -> Column:
    return F.coalesce("window_timestamp", "created_at")


def newest() -> list[Column]:
    return [history_time().desc(), F.col("id").desc()]


def has_field(df: DataFrame, path: str) -> bool:
    kind: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def support_flag(df: DataFrame, name: str = "enabled") -> Column:
    """Stored AI-support flag, nested or flat; false when absent."""
    flat = "ai_support" if name == "enabled" else "ai_support_conservative"
    for path in (f"model_outputs.ai_support.{name}", flat):
        if has_field(df, path):
            return parse_flag(F.col(path))
    return F.lit(False)


def _instant(value) -> Column | None:
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if not isinstance(value, datetime):
        try:
            value = datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
        except ValueError as error:
            raise ValueError(f"unreadable date filter: {value}") from error
    return F.lit(value.isoformat()).cast("timestamp")


def history_filter(df: DataFrame, filters: dict | None = None, alerts_only: bool = False) -> DataFrame:
    """Optional conjuncts, all of them plain predicates the scan can use."""
    filters = filters or {}
    if alerts_only:
        df = df.where(F.col("final_label") == "anomaly")
    for name in LABEL_COLUMNS:
        if filters.get(name):
            df = df.where(F.col(name) == str(filters[name]))
    start, end = _instant(filters.get("date_from")), _instant(filters.get("date_to"))
    if start is not None:
        df = df.where(history_time() >= start)
    if end is not None:
        df = df.where(history_time() <= end)
    wanted = bool_filter(filters.get("ai_support"))
    return df if wanted is None else df.where(support_flag(df) == F.lit(wanted))


def text_filter(
    df: DataFrame,
    filters: dict[str, str] | None = None,
    *,
    only_anomalies: bool = False,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """F16: text filters on address, port, protocol and action columns."""
    if only_anomalies:
        df = df.where(F.col("final_label") == "anomaly")
    for name in ("src_ip", "dst_ip", "dst_port", "protocol", "action"):
        query = (filters or {}).get(name) or ""
        if query.strip():
            df = df.where(contains_text(F.col(name), query))
    begin = F.col("window_start").cast("string").try_cast("timestamp")
    start, end = _instant(date_from), _instant(date_to)
    if start is not None:
        df = df.where(begin >= start)
    if end is not None:
        df = df.where(begin <= end)
    return df


def search(df: DataFrame, query: str, columns: list[str] = WINDOW_SEARCH) -> DataFrame:
    """rows whose text contains the query."""
    return df.where(contains_text(search_text(df, columns), query)) if query.strip() else df


def page_bounds(limit: int = 50, offset: int = 0) -> tuple[int, int]:
    return max(1, min(int(limit), 500)), max(0, int(offset))


def page(df: DataFrame, limit: int = 50, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """One page, newest first; a top-k on every task, not a full sort."""
    size, skip = page_bounds(limit, offset)
    return df.orderBy(*(order or newest())).offset(skip).limit(size)


def page_with_total(df: DataFrame, limit: int = 50, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """A page whose rows also carry the total of matching rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return attach_row(page(df, limit, offset, order), total)


def history_windows(df: DataFrame, filters: dict | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """T03."""
    return page(history_filter(df, filters), limit, offset)


def history_alerts(df: DataFrame, filters: dict | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """T03 over anomalies."""
    return page(history_filter(df, filters, alerts_only=True), limit, offset)


def live_windows(df: DataFrame, limit: int = 50, offset: int = 0, alerts_only: bool = False) -> DataFrame:
    """By creation time."""
    df = history_filter(df, alerts_only=alerts_only)
    return page(df, limit, offset, [F.col("created_at").desc(), F.col("id").desc()])


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup."""
    return df.where(F.col(column) == F.lit(value))


def executions(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """One row per execution with nested distributions, newest first.

    Rows are combined per (execution, labels) first, so an execution holding most of
    the history is reduced in every task before it is gathered.
    """
    df = history_filter(df, filters)
    for name, default in (("status", None), ("local_log_path", None), ("remote_path", None)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast("string"))
    labels = [*LABEL_COLUMNS, "status"]
    base = df.select(
        key_text(F.col("execution_id")).alias("execution_id"),
        *[key_text(F.col(c)).alias(c) for c in labels],
        "created_at", "local_log_path", "remote_path",
        history_time().alias("_time"), "id",
        support_flag(df).cast("int").alias("_ai"),
        support_flag(df, "conservative").cast("int").alias("_strong"),
    )
    combined = base.groupBy("execution_id", *labels).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("created_at").alias("first"),
        F.max("created_at").alias("last"),
        F.sum("_ai").alias("ai"),
        F.sum("_strong").alias("strong"),
        F.max(F.struct("_time", "id", "local_log_path", "remote_path")).alias("latest"),
    )
    once = F.struct("n", "first", "last", "ai", "strong", "latest", (F.col("final_label") == "anomaly").alias("anomaly"))
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.col(c).alias("value"), F.col("n").alias("m"), (once if i == 0 else F.lit(None)).alias("once"))
            for i, c in enumerate(labels)
        ]
    )
    values = (
        combined.select("execution_id", F.inline(entries))
        .groupBy("execution_id", "i", "value")
        .agg(
            F.sum("m").alias("m"),
            F.sum("once.n").alias("n"),
            F.sum(F.when(F.col("once.anomaly"), F.col("once.n"))).alias("anomalies"),
            F.min("once.first").alias("first"),
            F.max("once.last").alias("last"),
            F.sum("once.ai").alias("ai"),
            F.sum("once.strong").alias("strong"),
            F.max("once.latest").alias("latest"),
        )
    )
    entry = F.struct(F.col("value"), F.col("m").cast("long").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return (
        values.groupBy("execution_id")
        .agg(
            F.min("first").alias("first_seen_at"),
            F.max("last").alias("last_seen_at"),
            zero("n").alias("total_windows"),
            zero("anomalies").alias("total_anomalies"),
            zero("ai").alias("ai_support_count"),
            zero("strong").alias("ai_support_conservative_count"),
            *[
                F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("i") == i, entry)))).alias(f"{c}_distribution")
                for i, c in enumerate(labels)
            ],
            F.max("latest").alias("_latest"),
        )
        .withColumns({"local_log_path": F.col("_latest.local_log_path"), "remote_path": F.col("_latest.remote_path")})
        .drop("_latest")
        .orderBy(F.col("last_seen_at").desc(), "execution_id")
    )


def _rolled_totals(df: DataFrame, executions: bool = False) -> DataFrame:
    """Totals, AI-support counts, label distributions and, on request, executions; one scan, one row.

    Rows are combined per combination of keys first; the rest rolls up that table.
    """
    keys = [*(["_execution"] if executions else []), *LABEL_COLUMNS]
    named = {"_execution": key_text(F.col("execution_id")) if executions else None, **{c: key_text(F.col(c)) for c in LABEL_COLUMNS}}
    cube = df.groupBy(*[named[c].alias(c) for c in keys]).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(support_flag(df)).alias("ai"),
        F.count_if(support_flag(df, "conservative")).alias("strong"),
    )
    rolled = cube.groupingSets([[], *[[F.col(c)] for c in keys]], *keys).agg(
        F.grouping_id().alias("_level"), *[F.sum(c).cast("long").alias(c) for c in ("n", "ai", "strong")]
    )
    # The grouping id has a bit per key that was rolled up.
    every = 2 ** len(keys) - 1
    level = {c: every - 2 ** (len(keys) - 1 - i) for i, c in enumerate(keys)}
    total = lambda c: F.coalesce(F.max(F.when(F.col("_level") == every, F.col(c))), F.lit(0))
    alerts = (F.col("_level") == level["final_label"]) & (F.col("final_label") == "anomaly")
    return rolled.agg(
        total("n").alias("total_windows"),
        F.coalesce(F.max(F.when(alerts, F.col("n"))), F.lit(0)).alias("total_alerts"),
        total("ai").alias("ai_support_count"),
        total("strong").alias("ai_support_conservative_count"),
        *[
            F.map_from_entries(
                F.sort_array(F.collect_list(F.when(F.col("_level") == level[c], F.struct(F.col(c).alias("value"), "n"))))
            ).alias(f"{c}_distribution")
            for c in LABEL_COLUMNS
        ],
        *([F.count_if(F.col("_level") == level["_execution"]).alias("total_executions")] if executions else []),
    )


def live_totals(df: DataFrame) -> DataFrame:
    """Totals, AI-support counts and three distributions; one row."""
    return _rolled_totals(df)


def history_summary(
    windows: DataFrame, analyses: DataFrame | None = None, results: DataFrame | None = None, filters: dict | None = None
) -> DataFrame:
    """A10: one row of live and batch totals, distributions and newest rows.

    The windows are scanned twice (totals; newest rows), analyses twice, results once.
    """
    live = history_filter(windows, filters)
    summary = _rolled_totals(live, executions=True)
    row, order, alert = F.struct(*live.columns), F.struct(history_time(), F.col("id")), F.col("final_label") == "anomaly"
    others = [
        live.agg(
            F.max_by(row, order).alias("latest_window"),
            F.max_by(F.when(alert, row), F.when(alert, order)).alias("latest_alert"),
        )
    ]
    if analyses is not None:
        names = ["final_status", "predominant_attack_type", "predominant_risk_level"]
        others += [
            analyses.agg(
                F.count(F.lit(1)).alias("total_analyses"),
                F.max_by(F.struct(*analyses.columns), F.col("created_at")).alias("latest_analysis"),
            ),
            distribution_maps(distributions(analyses, names), names),
        ]
    if results is not None:
        others.append(results.agg(F.count(F.lit(1)).alias("total_results")))
    for one_row in others:
        summary = attach_row(summary, one_row)
    return summary


def entity_totals(windows: DataFrame, analyses: DataFrame, results: DataFrame) -> DataFrame:
    """Totals of every kind of record."""
    return history_summary(windows, analyses, results).select(
        "total_windows", "total_alerts", "total_executions", "total_analyses", "total_results"
    )


def dashboard(df: DataFrame, recent: int = 5) -> tuple[DataFrame, DataFrame]:
    """The totals row and the newest windows."""
    return live_totals(df), live_windows(df, recent)


def analyses_with_counts(analyses: DataFrame, results: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Analyses with the number of their results, newest first.

    Results are counted per analysis before the join, so an analysis with a third of
    all results reaches the join as one row.
    """
    counts = results.groupBy(key).agg(F.count(F.lit(1)).alias("n_results"))
    return (
        analyses.join(counts, key, "left")
        .withColumn("n_results", F.coalesce("n_results", F.lit(0)))
        .orderBy(F.col("created_at").desc(), key)
    )


def results_of(results: DataFrame, analysis_id, limit: int = 50, offset: int = 0) -> DataFrame:
    """Results of one analysis in their order."""
    return page(by_key(results, "analysis_id", analysis_id), limit, offset, [F.col("id")])


def classification(results: DataFrame) -> DataFrame:
    """Status, predominant attack and risk, mean confidence; one row.

    Ties go to the value seen first in ``window_start``, ``source_ip`` order, or in
    ``id`` order when there is an ``id``.
    """
    order = F.struct(*[c for c in (["id"] if "id" in results.columns else ["window_start", "source_ip"])])
    cube = results.groupBy("final_label", "attack_type", "risk_level").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("first"),
        F.sum(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("confidence"),
    )
    anomaly = F.col("final_label") == "anomaly"
    total = cube.agg(
        F.bool_or(anomaly).alias("any"), F.sum("confidence").alias("c"), F.sum("n").alias("n")
    ).withColumnsRenamed({"c": "_c", "n": "_n", "any": "_any"})
    kept = attach_row(cube, total).where(~F.col("_any") | anomaly)

    def mode(name: str, rows: DataFrame, default: str, out: str) -> DataFrame:
        per = rows.groupBy(name).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        return per.agg(
            F.coalesce(F.min_by(name, F.struct(-F.col("n"), F.col("first"))), F.lit(default)).alias(out)
        )

    attacks = mode("attack_type", kept.where(F.col("attack_type") != "normal"), "normal", "predominant_attack_type")
    risks = mode("risk_level", kept, "low", "predominant_risk_level")
    return attach_row(attach_row(total, attacks), risks).select(
        F.when(F.col("_any"), "anomaly").otherwise("normal").alias("final_status"),
        "predominant_attack_type",
        "predominant_risk_level",
        F.bround(F.col("_c") / F.col("_n"), 4).alias("confidence_avg"),
    )


def summary_counts(results: DataFrame) -> DataFrame:
    """Five headline counts."""
    return results.agg(
        *[F.count_if(F.col("final_label") == x).alias(x) for x in ("normal", "anomaly")],
        *[F.count_if(F.col("risk_level") == x).alias(x) for x in ("high", "medium", "low")],
    )


def timeline(df: DataFrame, limit: int = 12) -> DataFrame:
    """Newest windows, oldest first, with the drawn score."""
    score = F.coalesce(F.col("ensemble_score").cast("double"), F.lit(0.0))
    anomaly = F.col("final_label") == "anomaly"
    return (
        page(df, limit)
        .withColumns({"is_anomaly": anomaly, "score": F.greatest(score, F.when(anomaly, 0.75).otherwise(0.18))})
        .orderBy(history_time(), "id")
    )


def window_duration(start: Column, end: Column) -> Column:
    """whole seconds, at least one; 60 when a bound is missing."""
    seconds = F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6).cast("long")
    return F.coalesce(F.greatest(seconds, F.when(seconds.isNotNull(), F.lit(1))), F.lit(60))


def window_uid(source: Column, batch: tuple[Column, ...] = ()) -> Column:
    """repeatable row id of a window of one source."""
    fields = [source.alias("local_path"), F.col("window_id")]
    fields += [F.col(n).cast("string").alias(n) for n in ("window_start", "window_end")]
    fields += [c.alias(f"offset_{i}") for i, c in enumerate(batch)]
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def _first_of(df: DataFrame, *paths: str) -> Column:
    found = [F.nullif(F.col(p).cast("string"), F.lit("")) for p in paths if has_field(df, p)]
    return F.coalesce(*found, F.lit(None).cast("string"))


def compact_windows(df: DataFrame) -> DataFrame:
    """flat history row with fallbacks over nested payloads."""
    plain = [
        "id", "window_uid", "execution_id", "created_at", "status", "local_log_path", "remote_path",
        "parser_start_offset", "parser_end_offset", "window_id", "window_timestamp", "window_start", "window_end",
        "final_label", "attack_type", "risk_level", "decision_source", "confidence",
        "ensemble_score", "autoencoder_score", "isolation_score",
    ]
    engine = [f"{p}.decision_engine.{f}" for p in ("model_outputs", "raw") for f in ("decision_reason", "reason", "explanation")]
    reason = _first_of(df, "decision_reason", "raw.decision_reason", "raw.explanation", *engine)
    pick = lambda *names: _first_of(
        df, *[f"metadata.{n}" for n in names], *[f"raw.{n}" for n in names if n not in ("destination_ip_sample", "common_destination_ports")]
    )
    scores = [n for n in ("ensemble_score", "autoencoder_score", "isolation_score") if n in df.columns]
    return df.select(
        *[n for n in plain if n in df.columns],
        reason.alias("decision_reason"),
        reason.alias("explanation"),
        _flag(df, "enabled").alias("ai_support"),
        _flag(df, "conservative").alias("ai_support_conservative"),
        F.struct(*[F.col(n).alias(n.removesuffix("_score")) for n in scores]).alias("scores"),
        pick("src_ip").alias("src_ip"),
        pick("dst_ip", "destination_ip", "destination_ip_sample").alias("dst_ip"),
        pick("dst_port", "destination_port", "common_destination_ports").alias("dst_port"),
        pick("protocol").alias("protocol"),
        pick("action").alias("action"),
        *[n for n in ("features", "model_outputs", "metadata") if n in df.columns],
    )


def _flag(df: DataFrame, name: str) -> Column:
    paths = [f"{p}.ai_support.{name}" for p in ("model_outputs", "metadata")]
    return F.coalesce(*[F.col(p).cast("boolean") for p in paths if has_field(df, p)], F.lit(None).cast("boolean"))


def result_rows(df: DataFrame) -> DataFrame:
    """result columns in their order, those that exist."""
    return df.select(*[n for n in V.RESULT_COLUMNS if n in df.columns])


def module_cards(df: DataFrame) -> DataFrame:
    """status word of each module and the relevant features."""

    def status(pred: Column, text: Column) -> Column:
        return (
            F.when(pred.isNull() & text.isNull(), "Sem sinal")
            .when((pred == 1) | (text == "anomaly"), "Detectou")
            .when((pred == 0) | (text == "normal"), "Normal")
            .otherwise("Neutro")
        )

    none = F.lit(None).cast("string")
    return df.select(
        *[n for n in ("id", "window_id") if n in df.columns],
        status(F.col("pred_ae"), F.col("label_ae") if "label_ae" in df.columns else none).alias("autoencoder_status"),
        status(F.col("pred_if"), F.col("label_if") if "label_if" in df.columns else none).alias("isolation_forest_status"),
        F.when(F.col("heuristic_detected_attack"), "Disparou").otherwise("Neutra").alias("heuristic_status"),
        status(F.col("pred_ensemble"), none).alias("ensemble_status"),
        label(F.col("final_label"), "final_label").alias("decision_status"),
        label(F.col("attack_type"), "attack_type").alias("decision_value"),
        F.struct(*[F.col(n) for n in V.RELEVANT_FEATURES if n in df.columns]).alias("relevant_features"),
    )


def export_rows(df: DataFrame) -> DataFrame:
    """Nineteen labelled columns of the history export."""
    labelled = {"final_label", "attack_type", "risk_level", "decision_source"}

    def cell(name: str) -> Column:
        if name == "ai_support":
            return F.when(support_flag(df), "Sim").otherwise("Não")
        if name not in df.columns:
            return F.lit(None).cast("string")
        return label(F.col(name), name) if name in labelled else F.col(name)

    return df.select(*[cell(name).alias(header) for header, name in V.EXPORT_COLUMNS])
