"""Writers: tables, exports, idempotent inserts and model artefacts."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowguard.operators.history import export_rows
from flowguard.session import cut_lineage

ANALYSIS_BUCKETS = 64
MODEL_VERSION = 2


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Columnar copy of events, features or results."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV for export; nested columns as JSON."""
    flat = df.select(
        *[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "map", "array") else f.name for f in df.schema]
    )
    flat.write.mode(mode).csv(path, header=True)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of few rows as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)


def export_history(df: DataFrame, path: str) -> None:
    """Quoted CSV with display headers; an empty set is refused."""
    if df.isEmpty():
        raise ValueError("nothing to export")
    export_rows(df).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def export_summary(summary: DataFrame, path: str) -> None:
    """S13."""
    write_report(summary, path)


def read_if_present(spark: SparkSession, path: str, schema) -> DataFrame:
    """Table at ``path``, or no rows when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def insert_new_windows(records: DataFrame, path: str, day_col: str = "window_timestamp") -> dict[str, int]:
    """Append the windows whose ``window_uid`` is not stored yet.

    Rows without an id count as errors. The target is partitioned by the day of the
    window, which the id determines, so only the ids of the days at hand are read.
    New rows are written to reliable storage before the append, so a retry cannot see
    its own output.
    """
    spark = records.sparkSession
    valid = F.coalesce(F.col("window_uid"), F.lit("")) != ""
    dated = records.withColumn("window_day", F.coalesce(F.to_date(day_col), F.lit("1970-01-01").cast("date")))
    unique = dated.where(valid).dropDuplicates(["window_uid"])
    counts = dated.agg(
        F.count_if(valid).alias("valid"), F.count_if(~valid).alias("errors"),
        F.collect_set("window_day").alias("days"),
    ).first()
    stored = read_if_present(spark, path, dated.schema).where(F.col("window_day").isin(counts.days))
    fresh = cut_lineage(unique.join(stored.select("window_uid"), "window_uid", "left_anti").select(*dated.columns))
    saved = fresh.count()
    if saved:
        fresh.write.mode("append").partitionBy("window_day").parquet(path)
    return {"saved": saved, "skipped_duplicates": counts.valid - saved, "errors": counts.errors}


def replace_analysis(summary: DataFrame, results: DataFrame, folder: str) -> None:
    """Header and results of each analysis replace what was stored for it.

    Both tables are partitioned by a hash bucket of the id, so the number of files does
    not follow the number of analyses, and only touched buckets are rewritten. A bucket
    whose rows all went gets one marker row without an id, which ``read_analyses`` leaves
    out. Rows without an id are not stored.
    """
    spark = summary.sparkSession
    ids = cut_lineage(summary.select("analysis_id").union(results.select("analysis_id")).where("analysis_id is not null").distinct())
    bucket = F.pmod(F.xxhash64("analysis_id"), F.lit(ANALYSIS_BUCKETS)).cast("int").alias("bucket")
    touched = ids.select(bucket).distinct()
    numbers = [r.bucket for r in touched.collect()]
    for name, df in (("analyses", summary), ("results", results)):
        place = f"{folder}/{name}"
        placed = df.where("analysis_id is not null").select("*", bucket)
        kept = read_if_present(spark, place, placed.schema).where(F.col("bucket").isin(numbers)).join(ids, "analysis_id", "left_anti")
        merged = cut_lineage(placed.unionByName(kept))
        emptied = touched.join(merged.select("bucket").distinct(), "bucket", "left_anti")
        merged.unionByName(emptied, allowMissingColumns=True).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(place)


def read_analyses(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The stored ``analyses`` or ``results``."""
    return spark.read.parquet(f"{folder}/{name}").where("analysis_id is not null").drop("bucket")


def save_model(spark: SparkSession, model, path: str, model_id: str) -> None:
    """Node table and one row of parameters per model; a model saved again replaces itself."""
    import json

    forest, rec = model.forest, model.reconstruction
    place = f"{path}/model_id={model_id}"
    forest.nodes.write.mode("overwrite").parquet(f"{place}/nodes")
    payload = {
        "version": MODEL_VERSION,
        "created_at": datetime.now(timezone.utc).isoformat(),
        "forest": {
            "config": asdict(forest.config), "features": list(forest.features), "rows_per_tree": forest.rows_per_tree,
            "nodes": forest.size(), "offset": forest.offset, "stats": asdict(forest.stats) if forest.stats else None,
        },
        "reconstruction": {
            "scaler": asdict(rec.scaler), "components": [list(r) for r in rec.components],
            "threshold": rec.threshold, "stats": asdict(rec.stats) if rec.stats else None,
        },
        "ensemble": asdict(model.ensemble),
    }
    spark.createDataFrame([(model_id, json.dumps(payload))], "model_id string, manifest string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{place}/manifest")


def load_model(spark: SparkSession, path: str, model_id: str):
    """Read a stored model back; its nodes stay a table, and its manifest must fit them."""
    import json

    from flowguard.config import EnsembleConfig
    from flowguard.operators.forest import NODES, Forest, ForestConfig
    from flowguard.operators.reconstruction import Reconstruction
    from flowguard.operators.scaling import Scaler
    from flowguard.operators.scores import ScoreStats
    from flowguard.plans.batch import ScoringModel

    place = f"{path}/model_id={model_id}"
    payload = json.loads(spark.read.json(f"{place}/manifest").first().manifest)
    if payload.get("version") != MODEL_VERSION:
        raise ValueError(f"model {model_id} has version {payload.get('version')}, not {MODEL_VERSION}")
    f, r = payload["forest"], payload["reconstruction"]
    stats = lambda s: ScoreStats(**s) if s else None
    forest = Forest(
        ForestConfig(**f["config"]), tuple(f["features"]), f["rows_per_tree"],
        spark.read.schema(NODES).parquet(f"{place}/nodes"), f["offset"], stats(f["stats"]),
    )
    if forest.size() != f["nodes"]:
        raise ValueError(f"model {model_id} has {forest.size()} of {f['nodes']} nodes")
    scaler = Scaler(r["scaler"]["kind"], *[tuple(r["scaler"][n]) for n in ("columns", "centers", "scales")])
    rec = Reconstruction(scaler, tuple(tuple(x) for x in r["components"]), r["threshold"], stats(r["stats"]))
    return ScoringModel(forest, rec, EnsembleConfig(**payload["ensemble"]))
