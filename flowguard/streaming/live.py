"""The same transformations over a stream of lines.

Late rule of this path: rows behind the watermark are dropped. A window is emitted once,
when the watermark passes its end, so a window id never appears twice; a larger ``delay``
trades latency for lateness. ``streaming.store`` keeps counts instead and loses nothing.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowguard.operators.events import prepare_events
from flowguard.operators.parse import parse_filterlog
from flowguard.operators.reports import live_records, row_reports
from flowguard.operators.single import attach_row
from flowguard.operators.windows import finish_windows, fold_values, value_counts, window_features, window_seconds
from flowguard.plans.batch import ScoringModel, score_windows
from flowguard.sources.logs import read_lines, stream_lines
from flowguard.sources.sinks import insert_new_windows
from flowguard.session import cut_lineage


def streaming_windows(
    events: DataFrame, window: str | int = 60, *, delay: str = "0 seconds", sequence_col: str | None = None, addresses: str = "any"
) -> DataFrame:
    """Window table of a stream of prepared events.

    Two chained aggregations under one watermark; the state holds distinct values
    per open window, never events.
    """
    seconds = window_seconds(window)
    sequence = F.col(sequence_col) if sequence_col else F.lit(0).cast("long")
    keyed = events.withWatermark("timestamp", delay).withColumn("_window", F.window("timestamp", f"{seconds} seconds"))
    counts = value_counts(keyed, "_window", F.col("_window.start"), seconds, sequence, addresses)
    folded = fold_values(counts, "_window")
    return finish_windows(folded, F.col("_window.start"), F.col("_window.end"), seconds)


def split_closed(events: DataFrame, window: str | int = 60, flush: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events of finished buckets and those of the newest bucket.

    For runs without a stream; the newest bucket is attached as a scalar.
    """
    seconds = window_seconds(window)
    if flush:
        return events, events.where(F.lit(False))
    bucket = F.window("timestamp", f"{seconds} seconds").start
    keyed = events.withColumn("_bucket", bucket)
    newest = keyed.agg(F.max("_bucket").alias("_newest"))
    joined = attach_row(keyed, newest)
    drop = ("_bucket", "_newest")
    return (
        joined.where(F.col("_bucket") < F.col("_newest")).drop(*drop),
        joined.where(F.col("_bucket") >= F.col("_newest")).drop(*drop),
    )


def write_batch(
    model: ScoringModel, target: str, source_path: str, profile: str | None = None, reports: str | None = None
):
    """Score the closed windows of a micro-batch and insert those not stored.

    The checkpoint advances after this returns; a repeated batch inserts nothing new and
    replaces its own report folder. The batch is computed once, into reliable storage.
    """

    def write(windows: DataFrame, batch_id: int) -> None:
        scored = cut_lineage(score_windows(windows, model, profile=profile))
        insert_new_windows(live_records(scored, source_path=source_path, execution_id=f"batch-{batch_id}"), target)
        if reports:
            row_reports(scored).write.mode("overwrite").json(f"{reports}/batch={batch_id}")

    return write


def start_live(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    model: ScoringModel,
    *,
    default_year: int,
    window: str | int = 60,
    delay: str = "0 seconds",
    profile: str | None = None,
    poll: str = "1 second",
    finite: bool = False,
    addresses: str = "any",
    reports: str | None = None,
) -> StreamingQuery:
    """Follow a landing folder, score closed windows, keep them once."""
    events = prepare_events(parse_filterlog(stream_lines(spark, folder), default_year=default_year))
    writer = (
        streaming_windows(events, window, delay=delay, addresses=addresses)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch(model, target, folder, profile, reports))
    )
    writer = writer.trigger(availableNow=True) if finite else writer.trigger(processingTime=poll)
    return writer.start()


def replay(
    spark: SparkSession, path: str, model: ScoringModel, *, default_year: int, window: str | int = 60, profile: str | None = None
) -> DataFrame:
    """A finished log, pending windows included."""
    lines = read_lines(spark, path)
    events = prepare_events(
        parse_filterlog(lines, default_year=default_year, keep=("read_order",)), keep=("read_order",)
    )
    return score_windows(window_features(events, window, sequence_col="read_order", free_flags=False), model, profile=profile)


def run_metrics(query: StreamingQuery) -> DataFrame:
    """One row per micro-batch from the progress reports kept by the query."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    rows = []
    for progress in query.recentProgress:
        state = progress.get("stateOperators") or []
        rows.append(
            (
                str(progress["id"]),
                int(progress["batchId"]),
                int(progress.get("numInputRows") or 0),
                sum(int(s.get("numRowsTotal") or 0) for s in state),
                sum(int(s.get("numRowsDroppedByWatermark") or 0) for s in state),
                str((progress.get("eventTime") or {}).get("watermark")),
                datetime.now(timezone.utc),
            )
        )
    return spark.createDataFrame(
        rows,
        "query_id string, batch_id long, lines_new long, pending_values long, late_dropped long, watermark string, read_at timestamp",
    )
