"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.scalar import with_pinned


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` dealt out to all tasks by content, for work that costs far more than reading.

    A compact file has few row groups, and each is read by a single task.
    """
    events = table(spark, folder, "events")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return events.repartition(parts, *events.columns)


def _with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def fw(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared firewall events from ``events``."""
    return fw_of(table(spark, folder, "events"))


def fw_of(events: DataFrame) -> DataFrame:
    """The same for any frame shaped like ``events``."""
    kind, k = F.col("event_type"), F.col("k")
    return _with_k(events).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string")).alias("source_ip"),
        F.concat(F.lit("192.168.1."), (F.col("event_id") % 5).cast("string")).alias("destination_ip"),
        F.when(kind == "error", "icmp").when(k % 10 == 0, "udp").otherwise("tcp").alias("protocol"),
        F.when(kind.isin("purchase", "signup"), "block").otherwise("pass").alias("action"),
        F.concat(F.lit("em"), (F.col("event_id") % 2).cast("string")).alias("interface"),
        F.when(kind == "view", 443).when(kind == "click", 80).when(kind == "purchase", 22)
        .when(kind == "signup", 1000 + k).alias("destination_port"),
        F.when((kind == "error") | (k % 10 == 0), "").when(k % 3 == 0, "S")
        .when(k % 3 == 1, "PA").otherwise("A").alias("tcp_flags"),
        (F.floor("value").cast("double") + 40).alias("bytes"),
        F.lit(1.0).alias("packets"),
    )


FW = """
SELECT event_id, ts AS timestamp,
 concat('10.0.0.', CAST(user_id % 8 AS VARCHAR)) AS source_ip,
 concat('192.168.1.', CAST(event_id % 5 AS VARCHAR)) AS destination_ip,
 CASE WHEN event_type='error' THEN 'icmp' WHEN k % 10 = 0 THEN 'udp' ELSE 'tcp' END AS protocol,
 CASE WHEN event_type IN ('purchase','signup') THEN 'block' ELSE 'pass' END AS action,
 concat('em', CAST(event_id % 2 AS VARCHAR)) AS interface,
 CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80
      WHEN 'purchase' THEN 22 WHEN 'signup' THEN 1000 + k END AS destination_port,
 CASE WHEN event_type='error' OR k % 10 = 0 THEN '' WHEN k % 3 = 0 THEN 'S'
      WHEN k % 3 = 1 THEN 'PA' ELSE 'A' END AS tcp_flags,
 CAST(floor(value) AS DOUBLE) + 40 AS bytes, CAST(1 AS DOUBLE) AS packets
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)
"""


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Dense prepared events from ``lineitem``."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("10.1.0."), (F.col("l_suppkey") % 4).cast("string")).alias("source_ip"),
        F.lit("192.168.1.1").alias("destination_ip"),
        F.lit("tcp").alias("protocol"),
        F.lit("block").alias("action"),
        F.lit("em0").alias("interface"),
        (F.col("l_partkey") % 65536).cast("int").alias("destination_port"),
        F.lit("S").alias("tcp_flags"),
        (F.col("l_quantity") + 40).alias("bytes"),
        F.lit(1.0).alias("packets"),
    )


SCAN = """
SELECT l_orderkey * 8 + l_linenumber AS event_id, l_shipdate AS timestamp,
 concat('10.1.0.', CAST(l_suppkey % 4 AS VARCHAR)) AS source_ip,
 '192.168.1.1' AS destination_ip, 'tcp' AS protocol, 'block' AS action, 'em0' AS interface,
 CAST(l_partkey % 65536 AS INT) AS destination_port, 'S' AS tcp_flags,
 l_quantity + 40 AS bytes, CAST(1 AS DOUBLE) AS packets
FROM lineitem
"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw log lines written from ``fw``; ``event_id`` is kept for comparison."""
    tail = (
        F.when(F.col("protocol") == "icmp", "request,1")
        .when(F.col("protocol") == "udp", F.concat(F.lit("40000,"), "destination_port", F.lit(",0")))
        .otherwise(F.concat(F.lit("40000,"), "destination_port", F.lit(",0,"), "tcp_flags", F.lit(",1,,1024,,")))
    )
    number = F.when(F.col("protocol") == "tcp", "6").when(F.col("protocol") == "udp", "17").otherwise("1")
    head = [F.lit(x) for x in ("5", "", "", "1000000103")]
    middle = [F.lit(x) for x in ("in", "4", "0x0", "", "64", "0", "0", "none")]
    body = F.concat_ws(
        ",", *head, "interface", F.lit("match"), "action", *middle, number, "protocol",
        F.col("bytes").cast("int").cast("string"), "source_ip", "destination_ip", tail,
    )
    value = F.concat(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit(" fw01 filterlog["), F.col("event_id").cast("string"), F.lit("]: "), body,
    )
    # pinned, or a filter on the line would make it below the exchange as well
    return with_pinned(fw_of(dealt(spark, folder)), "value", value).select("event_id", "value")


def hist(spark: SparkSession, folder: str) -> DataFrame:
    """Scored history from ``events``."""
    value, kind, ident = F.col("value"), F.col("event_type"), F.col("event_id")
    return _with_k(table(spark, folder, "events")).select(
        ident.alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(ident % 7 != 0, F.col("ts").cast("timestamp")).alias("window_timestamp"),
        F.concat(F.lit("exec-"), (ident % 50).cast("string")).alias("execution_id"),
        F.when(value >= 100, "anomaly").otherwise("normal").alias("final_label"),
        F.when(value < 100, "normal").when(kind == "view", "port_scan").when(kind == "click", "brute_force")
        .when(kind == "purchase", "syn_flood").when(kind == "signup", "ssh_suspicious").alias("attack_type"),
        F.when(value >= 150, "high").when(value >= 100, "medium").otherwise("low").alias("risk_level"),
        (value / 500).alias("ensemble_score"),
        (value / 100).alias("autoencoder_score"),
        (F.col("k") / 100.0).cast("double").alias("if_norm"),
        F.when(value >= 80, 1).otherwise(0).alias("if_pred"),
        F.when(value >= 100, 1).otherwise(0).alias("ae_pred"),
    )


HIST = """
SELECT event_id AS id, ts AS created_at,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS window_timestamp,
 concat('exec-', CAST(event_id % 50 AS VARCHAR)) AS execution_id,
 CASE WHEN value >= 100 THEN 'anomaly' ELSE 'normal' END AS final_label,
 CASE WHEN value < 100 THEN 'normal' WHEN event_type = 'view' THEN 'port_scan'
      WHEN event_type = 'click' THEN 'brute_force' WHEN event_type = 'purchase' THEN 'syn_flood'
      WHEN event_type = 'signup' THEN 'ssh_suspicious' END AS attack_type,
 CASE WHEN value >= 150 THEN 'high' WHEN value >= 100 THEN 'medium' ELSE 'low' END AS risk_level,
 value / 500 AS ensemble_score, value / 100 AS autoencoder_score,
 CAST(k / CAST(100 AS DOUBLE) AS DOUBLE) AS if_norm,
 CASE WHEN value >= 80 THEN 1 ELSE 0 END AS if_pred,
 CASE WHEN value >= 100 THEN 1 ELSE 0 END AS ae_pred
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)
"""
