"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.catalog import tables
from flowguard.catalog.history import analyses, results, stored
from flowguard.catalog.tables import HIST
from flowguard.operators.history import compact_windows
from flowguard.operators.single import attach_row
from flowguard.session import ensure_checkpoint_dir
from flowguard.sources import datasets, sinks
from flowguard.sources.logs import read_lines

LINES_PER_FILE = 4000


def _place(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log files read back with their line numbers."""
    place = _place(spark, "lines")
    part = F.floor(F.col("event_id") / LINES_PER_FILE).alias("part")
    ordered = tables.lines(spark, folder).select(part, "event_id", "value").repartition("part").sortWithinPartitions("part", "event_id")
    ordered.select("part", "value").write.partitionBy("part").text(place)
    event_id = F.regexp_extract("value", r"filterlog\[(\d+)\]", 1).cast("long").alias("event_id")
    file = F.regexp_extract("source_path", r"/part=(\d+)/", 1).cast("long").alias("file")
    return read_lines(spark, place, line_numbers=True).select(file, event_id, "line_number")


def _flows(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return tables.table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias(" Flow Duration"),
        F.floor("value").alias("Total Length of Fwd Packets"),
        (F.col("event_id") % 9).alias(" Total Fwd Packets"),
        F.when(F.col("event_id") % 11 == 0, "Infinity").otherwise((F.col("event_id") % 7 + 0.5).cast("string")).alias("Average Packet Size"),
        F.col("event_id").alias(" Destination Port"),
        F.when(kind == "view", "BENIGN").when(kind == "click", "Normal").otherwise("DoS").alias(" Label"),
    )


def csv_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Comma and semicolon files of one folder as one dataset."""
    place = _place(spark, "flows")
    rows = _flows(spark, folder)
    for rest, sep in enumerate(",;"):
        rows.where(F.col("event_id") % 2 == rest).drop("event_id").write.mode("append").csv(place, header=True, sep=sep, ignoreLeadingWhiteSpace=False)
    return datasets.prepare_dataset(datasets.load_datasets(spark, place)).select(
        F.col("ports").cast("long").alias("event_id"), "connections", "bytes", "packets", "packet_size", "label", "target"
    )


def insert_twice(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the windows is stored, then all are offered."""
    place = _place(spark, "windows")
    uid = F.when(F.col("id") % 100 != 0, F.concat(F.to_date("created_at").cast("string"), F.lit("-"), (F.col("id") % 50).cast("string")))
    rows = tables.hist(spark, folder).select("id", "created_at", uid.alias("window_uid"))
    first = sinks.insert_new_windows(rows.where(F.col("id") % 3 == 0), place, "created_at")
    second = sinks.insert_new_windows(rows, place, "created_at")
    told = [F.lit(x).cast("long").alias(n) for x, n in ((first["saved"], "first_saved"), (second["saved"], "second_saved"), (second["skipped_duplicates"], "skipped"), (second["errors"], "errors"))]
    return spark.read.parquet(place).select("window_uid", F.col("window_day").cast("string").alias("window_day"), *told)


def replaced_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Every third analysis is stored again with its first lines only, or none."""
    place = _place(spark, "analyses")
    heads, lines = analyses(spark, folder).select("analysis_id", "final_status"), results(spark, folder)
    sinks.replace_analysis(heads, lines, place)
    again = F.col("analysis_id") % 3 == 0
    sinks.replace_analysis(heads.where(again).withColumn("final_status", F.lit("again")), lines.where(again & (F.col("id") < F.col("analysis_id") % 4)), place)
    counts = sinks.read_analyses(spark, place, "results").groupBy("analysis_id").agg(F.count("*").alias("n_results"), F.sum("window_id").alias("windows"))
    return sinks.read_analyses(spark, place, "analyses").join(counts, "analysis_id", "left").select(
        "analysis_id", "final_status", F.coalesce("n_results", F.lit(0)).alias("n_results"), "windows"
    )


def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The quoted export, read back as text."""
    place = _place(spark, "export")
    sinks.export_history(compact_windows(stored(spark, folder)), place)
    read = spark.read.csv(place, header=True, escape='"')
    header = {name: shown for shown, name in V.EXPORT_COLUMNS}
    return read.select(*[F.col(f"`{header[n]}`").alias(n) for n in ("window_id", "execution_id", "dst_ip", "dst_port", "action")])


def _training(spark: SparkSession, folder: str) -> str:
    """A training file: base features by name, a label of words, blanks in the header."""
    place = _place(spark, "training")
    kind = F.col("event_type")
    rows = tables.table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias(" connections"), F.floor("value").cast("string").alias("bytes"), F.lit("2").alias("packets"),
        F.when(F.col("event_id") % 6 == 0, "NaN").otherwise((F.col("event_id") % 5).cast("string")).alias("packet_size"),
        (F.col("event_id") % 9).cast("string").alias("ports"), F.when(kind == "view", "BENIGN").otherwise("DoS").alias("label"),
    )
    rows.write.csv(place, header=True, ignoreLeadingWhiteSpace=False)
    return place


def csv_training(spark: SparkSession, folder: str) -> DataFrame:
    """Features and labels of a training file."""
    return datasets.load_training(spark, _training(spark, folder)).select(
        F.col("connections").cast("long").alias("event_id"), "bytes", "packet_size", "bytes_per_packet", F.round("log1p_bytes", 6).alias("log1p_bytes"), "y"
    )


def csv_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the same file without its labels."""
    rows = datasets.load_inference(spark, _training(spark, folder))
    return rows.select(F.col("connections").cast("long").alias("event_id"), "ports", "packets_per_connection", F.round("log1p_ports", 6).alias("log1p_ports"))


def written_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Columnar copy by day and CSV copy, nested values as JSON, read back and joined."""
    columns, text = _place(spark, "table"), _place(spark, "csv")
    rows = tables.hist(spark, folder).select("id", F.to_date("created_at").alias("day"), F.struct("risk_level", "if_pred").alias("nested"))
    sinks.write_table(rows, columns, partition_by=["day"])
    sinks.write_csv(rows, text)
    copy = spark.read.csv(text, header=True).select(F.col("id").cast("long").alias("id"), F.get_json_object("nested", "$.risk_level").alias("risk_level"))
    return spark.read.parquet(columns).select("id", F.col("day").cast("string").alias("day"), F.col("nested.if_pred").alias("if_pred")).join(copy, "id")


def written_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A report of few rows and a summary as JSON, read back."""
    report, summary = _place(spark, "report"), _place(spark, "summary")
    rows = tables.hist(spark, folder)
    sinks.write_report(rows.groupBy("risk_level").agg(F.count("*").alias("n"), F.max("id").alias("last")), report)
    sinks.export_summary(rows.agg(F.count("*").alias("total")), summary)
    total = spark.read.json(summary).select(F.col("total").alias("total"))
    return attach_row(spark.read.json(report).select("risk_level", "n", "last"), total)


QUERIES = {
    f.__name__: f
    for f in (source_lines, csv_flows, insert_twice, replaced_analyses, export_csv, csv_training, csv_inference, written_tables, written_reports)
}

_UID = """WITH r AS (SELECT event_id, CAST(ts AS DATE) AS day,
 CASE WHEN event_id % 100 <> 0 THEN concat(strftime(ts, '%Y-%m-%d'), '-', event_id % 50) END AS uid FROM events),
 n AS (SELECT count(DISTINCT uid) FILTER (WHERE event_id % 3 = 0) AS one, count(DISTINCT uid) AS every, count(uid) AS valid, count(*) - count(uid) AS bad FROM r)"""

ORACLES = {
    "source_lines": f"""SELECT event_id // {LINES_PER_FILE} AS file, event_id,
 row_number() OVER (PARTITION BY event_id // {LINES_PER_FILE} ORDER BY event_id) AS line_number FROM events""",
    "csv_flows": """SELECT event_id, CAST(user_id AS DOUBLE) AS connections, CAST(floor(value) AS DOUBLE) AS bytes,
 CAST(event_id % 9 AS DOUBLE) AS packets, CASE WHEN event_id % 11 = 0 THEN 0.0::DOUBLE ELSE (event_id % 7 + 0.5)::DOUBLE END AS packet_size,
 CASE event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'Normal' ELSE 'DoS' END AS label,
 CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS target FROM events""",
    "insert_twice": f"""{_UID} SELECT DISTINCT uid AS window_uid, strftime(day, '%Y-%m-%d') AS window_day, one AS first_saved,
 every - one AS second_saved, valid - every + one AS skipped, bad AS errors FROM r, n WHERE uid IS NOT NULL""",
    "replaced_analyses": """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_partkey) AS w FROM lineitem
 WHERE l_orderkey % 3 <> 0 OR l_linenumber < l_orderkey % 4 GROUP BY 1)
SELECT o_orderkey AS analysis_id, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderstatus END AS final_status,
 coalesce(n, 0) AS n_results, CAST(w AS BIGINT) AS windows FROM orders LEFT JOIN l ON k = o_orderkey""",
    "csv_training": """WITH r AS (SELECT event_id, CAST(floor(value) AS DOUBLE) AS bytes, CASE WHEN event_id % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id % 5 AS DOUBLE) END AS packet_size, event_type FROM events)
SELECT event_id, bytes, packet_size, bytes / 2 AS bytes_per_packet, round(ln(1 + bytes), 6) AS log1p_bytes, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS y FROM r""",
    "csv_inference": """SELECT event_id, CAST(event_id % 9 AS DOUBLE) AS ports, CASE WHEN event_id = 0 THEN CAST(0 AS DOUBLE) ELSE 2 / event_id END AS packets_per_connection,
 round(ln(1 + event_id % 9), 6) AS log1p_ports FROM events""",
    "written_tables": f"""SELECT id, strftime(created_at, '%Y-%m-%d') AS day, if_pred, risk_level FROM ({HIST})""",
    "written_reports": f"SELECT risk_level, count(*) AS n, max(id) AS last, (SELECT count(*) FROM events) AS total FROM ({HIST}) GROUP BY 1",
    "export_csv": """SELECT concat('w-', event_id) AS window_id, concat('exec-', event_id % 50) AS execution_id,
 concat('192.168.1.', event_id % 5) AS dst_ip, '22,80' AS dst_port, 'block' AS action FROM events""",
}
