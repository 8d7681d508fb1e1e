"""Live windows kept as mergeable counts, so that late lines are never lost.

A micro-batch adds the value counts of its events to a table and recomputes the windows it
touched from the counts of all batches. A window is scored when it is due: its bucket is
older than the newest one seen (by ``delay`` more, if given), or the run is flushed. A
later event of a scored window writes a new version of it, and readers see the newest
version of each window id, so no id appears twice.

Folders below ``root``: ``counts`` (value counts), ``windows`` (scored versions), ``ledger``
(one row per committed batch, written last) and ``failures``. The folders of a batch are
named by its version and overwritten when the batch is redone; a batch in the ledger is
left alone, and readers take only batches in the ledger. A batch that ends halfway is
therefore redone as a whole and shows once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowguard.operators.events import prepare_events
from flowguard.operators.parse import parse_filterlog
from flowguard.operators.windows import finish_windows, fold_values, value_counts, window_seconds
from flowguard.sources.sinks import read_if_present

LEDGER = (
    "version long, batch_id long, status string, lines_new long, events_new long, files_new long, windows_touched long, "
    "windows_generated long, windows_revised long, windows_pending long, newest timestamp, started_at timestamp, ended_at timestamp"
)
FAILURES = "version long, batch_id long, status string, error string, ended_at timestamp"
ORDER = "struct<timestamp:timestamp,destination_ip:string,sequence:struct<modified:timestamp,path:string,block:long,row:long>>"
COUNTS = f"_start timestamp, source_ip string, attribute int, value string, n long, first {ORDER}, bytes double, packets double, version long, day date"
FLUSH = 1


@dataclass(frozen=True)
class LiveStore:
    """Where a run keeps its tables, and how wide its windows are."""

    root: str
    window: str | int = 60
    delay: str | int = 0

    @property
    def seconds(self) -> int:
        return window_seconds(self.window)

    @property
    def delay_seconds(self) -> int:
        return window_seconds(self.delay) if self.delay else 0

    def place(self, name: str, version: int | None = None) -> str:
        folder = f"{self.root.rstrip('/')}/{name}"
        return folder if version is None else f"{folder}/version={version}"


def prepare(spark: SparkSession, store: LiveStore) -> None:
    """An empty ledger where there is none, so that a first batch finds one."""
    spark.createDataFrame([], LEDGER).drop("version").coalesce(1).write.mode("ignore").parquet(store.place("ledger", -1))


def ledger(spark: SparkSession, store: LiveStore) -> DataFrame:
    """One row per committed batch and flush: lines, windows, pending windows, files, status, times."""
    return read_if_present(spark, store.place("ledger"), LEDGER)


def failures(spark: SparkSession, store: LiveStore) -> DataFrame:
    """The last error of every batch that failed and is not in the ledger yet."""
    known = ledger(spark, store).select("version")
    return read_if_present(spark, store.place("failures"), FAILURES).join(known, "version", "left_anti")


def _committed(df: DataFrame, store: LiveStore) -> DataFrame:
    return df.join(ledger(df.sparkSession, store).select("version"), "version", "left_semi")


def read_versions(spark: SparkSession, store: LiveStore) -> DataFrame:
    """Every committed version of every window."""
    return _committed(spark.read.parquet(store.place("windows")), store)


def read_windows(spark: SparkSession, store: LiveStore) -> DataFrame:
    """The newest version of every window; an id determines its start, so versions meet by day."""
    newest = Window.partitionBy("day", "window_id").orderBy(F.desc("version"))
    return read_versions(spark, store).withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def batch_counts(events: DataFrame, seconds: int, addresses: str = "any") -> DataFrame:
    """Mergeable counts of the events of one batch, with the day of their window."""
    keyed = events.withColumn("_start", F.window("timestamp", f"{seconds} seconds").start)
    counts = value_counts(keyed, "_start", F.col("_start"), seconds, F.col("read_order"), addresses, free_flags=True)
    return counts.withColumn("day", F.to_date("_start"))


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of several batches added up."""
    return counts.groupBy("_start", "source_ip", "attribute", "value").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")
    )


def _due(store: LiveStore, newest: datetime | None) -> datetime | None:
    return newest - timedelta(seconds=store.delay_seconds) if newest else None


def _write_windows(spark: SparkSession, store: LiveStore, version: int, before: datetime | None, now: datetime | None, flush: bool, score: Callable[[DataFrame], DataFrame]) -> dict:
    """Score and write the due windows that changed; (``before``, ``now``): newest bucket of earlier batches and with this one."""
    known = ledger(spark, store).select("version").union(spark.range(version, version + 1).toDF("version"))
    counts = read_if_present(spark, store.place("counts"), COUNTS).join(F.broadcast(known), "version", "left_semi")
    keys = ["day", "_start", "source_ip"]
    closed, was_closed = _due(store, now), _due(store, before)
    fresh = F.col("version") == version
    if flush:
        changed = F.lit(True) if was_closed is None else F.col("_start") >= F.lit(was_closed)
    else:
        newly = F.lit(True) if was_closed is None else F.col("_start") >= F.lit(was_closed)
        changed = (F.col("_start") < F.lit(closed)) & (fresh | newly)
    due = counts.where(changed).select(*keys).distinct()
    days = [r.day for r in due.select("day").distinct().collect()]
    rows = counts.where(F.col("day").isin(days)).join(due, keys, "left_semi")
    folded = fold_values(merged_counts(rows), "_start")
    end = F.col("_start") + F.make_dt_interval(secs=F.lit(store.seconds))
    windows = finish_windows(folded, F.col("_start"), end, store.seconds)
    place = store.place("windows", version)
    scored = score(windows).withColumn("day", F.to_date("window_start"))
    scored.write.mode("overwrite").partitionBy("day").parquet(place)
    written = spark.read.schema(scored.schema).parquet(place)
    earlier = read_if_present(spark, store.place("windows"), "window_id string, version long, day date").where((F.col("version") < version) & F.col("day").isin(days))
    earlier = earlier.join(F.broadcast(known), "version", "left_semi").select("window_id").distinct()
    total = written.count()
    if not total:  # an empty file, so that readers find the columns
        scored.drop("day").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{place}/day=1970-01-01")
    revised = written.select("window_id").join(earlier, "window_id", "left_semi").count()
    waiting = 0 if flush or now is None else counts.where(F.col("_start") >= F.lit(closed)).select(*keys).distinct().count()
    return {"windows_generated": total - revised, "windows_revised": revised, "windows_pending": waiting}


def _commit(spark: SparkSession, store: LiveStore, row: dict) -> None:
    names = [part.split(" ")[0] for part in LEDGER.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], LEDGER).drop("version").coalesce(1).write.mode("overwrite").parquet(store.place("ledger", row["version"]))


def write_batch(store: LiveStore, score: Callable[[DataFrame], DataFrame], *, default_year: int, addresses: str = "any"):
    """What a stream of lines does with each micro-batch.

    The lines are parsed once, for the counts; everything after reads those.
    """

    def write(lines: DataFrame, batch_id: int) -> None:
        spark, version = lines.sparkSession, 2 * batch_id
        if not ledger(spark, store).where(F.col("version") == version).isEmpty():
            return
        started = datetime.now(timezone.utc)
        try:
            seen = Observation()
            order = F.struct(F.col("modified"), F.col("source_path").alias("path"), F.col("block"), F.monotonically_increasing_id().alias("row"))
            numbered = lines.observe(seen, F.count(F.lit(1)).alias("lines")).withColumn("read_order", order)
            events = prepare_events(parse_filterlog(numbered, default_year=default_year, keep=("read_order",)), keep=("read_order",))
            place = store.place("counts", version)
            batch_counts(events, store.seconds, addresses).write.mode("overwrite").partitionBy("day").parquet(place)
            own = read_if_present(spark, place, ", ".join(p for p in COUNTS.split(", ") if not p.startswith("version ")))
            mine = own.agg(F.max("_start").alias("newest"), F.count_distinct("_start", "source_ip").alias("touched"), F.coalesce(F.sum(F.when(F.col("attribute") == 1, F.col("n"))), F.lit(0)).alias("events")).first()
            before = ledger(spark, store).agg(F.max("newest")).first()[0]
            newest = max((t for t in (before, mine.newest) if t), default=None)
            result = _write_windows(spark, store, version, before, newest, False, score)
            files = lines.select("source_path").distinct().count()
            _commit(spark, store, {
                "version": version, "batch_id": batch_id, "status": "ok" if mine.events else "empty", "lines_new": seen.get["lines"], "events_new": mine.events,
                "files_new": files, "windows_touched": mine.touched, "newest": newest, "started_at": started, "ended_at": datetime.now(timezone.utc), **result,
            })
        except Exception as error:
            failed = spark.createDataFrame([(batch_id, "error", str(error)[:2000], datetime.now(timezone.utc))], FAILURES.removeprefix("version long, "))
            failed.coalesce(1).write.mode("overwrite").parquet(store.place("failures", version))
            raise

    return write


def flush(spark: SparkSession, store: LiveStore, score: Callable[[DataFrame], DataFrame]) -> None:
    """Score the windows that still wait, as a version after the last batch's; nothing to do, nothing written."""
    last = ledger(spark, store).agg(F.max("version").alias("version"), F.max("newest").alias("newest"), F.max_by("windows_pending", "version").alias("waiting")).first()
    if last.version is None or not last.waiting:
        return
    version, started = last.version // 2 * 2 + FLUSH, datetime.now(timezone.utc)
    result = _write_windows(spark, store, version, last.newest, last.newest, True, score)
    _commit(spark, store, {
        "version": version, "batch_id": last.version // 2, "status": "flushed", "lines_new": 0, "events_new": 0, "files_new": 0, "windows_touched": 0,
        "newest": last.newest, "started_at": started, "ended_at": datetime.now(timezone.utc), **result,
    })


def landed_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of the files that land in a folder, with what orders them.

    A rotated log lands as a file of its own; a file is read once, whatever its name.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    meta = F.col("_metadata")
    return reader.text(folder).select(
        "value", meta["file_path"].alias("source_path"), meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("block")
    )


def follow(
    spark: SparkSession, folder: str, store: LiveStore, checkpoint: str, score: Callable[[DataFrame], DataFrame], *,
    default_year: int, poll: str = "1 second", finite: bool = False, files_per_trigger: int | None = None, addresses: str = "any",
) -> StreamingQuery:
    """Follow a landing folder; a finite run ends after what is there (then ``flush``)."""
    prepare(spark, store)
    writer = (
        landed_lines(spark, folder, files_per_trigger)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch(store, score, default_year=default_year, addresses=addresses))
    )
    return (writer.trigger(availableNow=True) if finite else writer.trigger(processingTime=poll)).start()


def replay_folder(
    spark: SparkSession, folder: str, store: LiveStore, checkpoint: str, score: Callable[[DataFrame], DataFrame], **options
) -> DataFrame:
    """Everything in the folder, pending windows included."""
    follow(spark, folder, store, checkpoint, score, finite=True, **options).awaitTermination()
    flush(spark, store, score)
    return read_windows(spark, store)
