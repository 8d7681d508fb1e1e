"""Registered queries that run as finite streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog import tables
from flowguard.catalog.windows import MODES_SQL, WINDOW_6H
from flowguard.session import ensure_checkpoint_dir
from flowguard.streaming.live import streaming_windows
from flowguard.streaming.store import LiveStore, ledger, read_versions, read_windows, replay_folder

COLUMNS = ["window_id", "event_count", "bytes", "protocol", "destination_port_count", "blocked_count"]

REPLAYED = [
    "window_id", "event_count", "bytes", "packets", "destination_ip_count", "destination_port_count", "destination_port_min", "destination_port_max",
    "tcp_syn_count", "tcp_pa_count", "blocked_count", "passed_count",
]


def stream_finite(spark: SparkSession, folder: str) -> DataFrame:
    """Windows closed by the watermark after all of ``events`` was streamed."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    schema = tables.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    windows = streaming_windows(tables.fw_of(raw), WINDOW_6H, sequence_col="event_id", addresses="ipv4")
    query = (
        windows.select(*COLUMNS)
        .writeStream.outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .format("parquet")
        .option("path", f"{base}/windows")
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/windows").select(*COLUMNS, F.lit("closed").alias("state"))


def _landed(spark: SparkSession, folder: str) -> tuple[str, LiveStore, str]:
    """The log of all events in three files, whose middle third lands last, and an empty store.

    All tasks make the lines; the one that owns a file only writes them.
    """
    base = f"{ensure_checkpoint_dir(spark)}/replay-{uuid4().hex}"
    lines = tables.lines(spark, folder).where("value IS NOT NULL")
    for i in (0, 2, 1):
        part = lines.where(F.floor(F.pmod("event_id", F.lit(300)) / 100) == i).select("value")
        part.repartition(1).write.mode("append").text(f"{base}/in")
    return f"{base}/in", LiveStore(f"{base}/store", WINDOW_6H), f"{base}/checkpoint"


def _replayed(spark: SparkSession, folder: str) -> LiveStore:
    landed, store, checkpoint = _landed(spark, folder)
    replay_folder(spark, landed, store, checkpoint, lambda w: w, default_year=2024, files_per_trigger=1)
    return store


def replay_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text lines through three micro-batches, most of them late in the last two, then a flush."""
    return read_windows(spark, _replayed(spark, folder)).select(*REPLAYED)


def replay_versions(spark: SparkSession, folder: str) -> DataFrame:
    """How the newest version of every window relates to all of its versions."""
    versions = read_versions(spark, _replayed(spark, folder))
    counted = versions.groupBy("window_id").agg(F.max("event_count").alias("most"), F.max_by("event_count", "version").alias("last"), F.count_distinct("version").alias("versions"), F.count("*").alias("rows"))
    return counted.select("window_id", F.col("last").alias("event_count"), (F.col("most") == F.col("last")).alias("last_is_largest"), (F.col("rows") == F.col("versions")).alias("once_per_version"))


def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the whole run."""
    return ledger(spark, _replayed(spark, folder)).agg(
        F.sum("lines_new").alias("lines"), F.sum("events_new").alias("events"), F.sum("files_new").alias("files"), F.sum("windows_generated").alias("windows"),
        F.max_by("windows_pending", "version").alias("pending"), F.max_by("status", "version").alias("status"),
        F.count_if(F.col("status") == "ok").alias("batches"),
    )


QUERIES = {f.__name__: f for f in (stream_finite, replay_text, replay_versions, run_totals)}
ORACLES = {
    "replay_text": f"WITH w AS ({MODES_SQL}) SELECT {', '.join(REPLAYED)} FROM w",
    "replay_versions": f"WITH w AS ({MODES_SQL}) SELECT window_id, event_count, true AS last_is_largest, true AS once_per_version FROM w",
    "run_totals": f"""WITH w AS ({MODES_SQL}) SELECT (SELECT count(*) FROM events) AS lines, (SELECT count(*) FROM events) AS events, 3 AS files, count(*) AS windows,
 0 AS pending, 'flushed' AS status, 3 AS batches FROM w""",
    "stream_finite": f"""
WITH w AS ({MODES_SQL})
SELECT window_id, event_count, bytes, protocol, destination_port_count, blocked_count, 'closed' AS state
FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)
"""
}
