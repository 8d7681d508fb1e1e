"""One key with most of the rows gives the same results and spreads over tasks."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowguard.operators.history import executions, live_totals
from flowguard.operators.rules import refine_with_context
from flowguard.operators.windows import value_counts, window_features


def events(spark, n):
    """Two thirds of the events come from one source in one window."""
    hot = F.col("id") % 3 != 0
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.timestamp_seconds(F.when(hot, F.lit(1704067200)).otherwise(F.lit(1704067200) + F.col("id"))).alias("timestamp"),
        F.when(hot, "10.0.0.1").otherwise(F.concat(F.lit("10.0.1."), (F.col("id") % 200).cast("string"))).alias("source_ip"),
        F.lit("tcp").alias("protocol"), F.lit("block").alias("action"), F.lit("em0").alias("interface"),
        F.concat_ws(".", F.lit("11"), F.lit("0"), (F.col("id") % 250).cast("string"), (F.col("id") % 199).cast("string")).alias("destination_ip"),
        (F.col("id") % 60000).cast("int").alias("destination_port"), F.lit("S").alias("tcp_flags"),
        F.lit(60.0).alias("bytes"), F.lit(1.0).alias("packets"),
    )


def test_hot_window(spark):
    df = events(spark, 30_000)
    for addresses in ("any", "ipv4"):
        hot = window_features(df, 60, sequence_col="seq", addresses=addresses).where("source_ip = '10.0.0.1'").collect()
        assert len(hot) == 1
        w = hot[0]
        assert (w.event_count, w.tcp_syn_count, w.destination_port_count) == (20_000, 20_000, 20_000)
        assert w.common_destination_ports.count(",") == 9 and w.bytes == 1_200_000.0


def test_hot_window_is_counted_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keyed = events(spark, 30_000).withColumn("_start", F.window("timestamp", "60 seconds").start)
        counts = value_counts(keyed, "_start", F.col("_start"), 60, F.col("seq"), "ipv4")
        sizes = counts.where("source_ip = '10.0.0.1'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 0.5 * sum(r["count"] for r in sizes)


def test_long_flow_is_split_by_time(spark):
    begin = datetime(2024, 1, 1)
    rows = [(i, begin + timedelta(seconds=50 * i), "strong" if i % 40 == 0 else "weak") for i in range(2_000)]
    size = F.when(F.col("kind") == "strong", 10).otherwise(2)
    df = spark.createDataFrame(rows, "i int, window_start timestamp, kind string").select(
        "i", "window_start", F.lit("a").alias("source_ip"), F.lit("b").alias("destination_ip_sample"),
        F.lit("tcp").alias("protocol"), F.lit("block").alias("action"), F.lit("22").alias("common_destination_ports"),
        F.lit(1).alias("destination_ip_count"), size.alias("blocked_count"), size.cast("double").alias("packets"),
        size.cast("double").alias("connections"), F.lit(True).alias("heuristic_detected_attack"),
        F.when(F.col("kind") == "strong", "brute_force").otherwise("ssh_suspicious").alias("heuristic_attack_type"),
        F.lit(0.84).alias("heuristic_confidence"), F.lit("x").alias("heuristic_reason"),
    )
    got = {r.i for r in refine_with_context(df).where("heuristic_attack_type = 'brute_force'").collect()}
    want = {i + d for i in range(0, 2_000, 40) for d in (-2, -1, 0, 1, 2) if 0 <= i + d < 2_000}
    assert got == want


def test_hot_execution(spark):
    df = spark.range(9_000).select(
        "id", F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("created_at"),
        F.lit(None).cast("timestamp").alias("window_timestamp"),
        F.when(F.col("id") % 3 != 0, "e0").otherwise(F.concat(F.lit("e"), (F.col("id") % 50).cast("string"))).alias("execution_id"),
        F.when(F.col("id") % 2 == 0, "anomaly").otherwise("normal").alias("final_label"),
        F.when(F.col("id") % 5 != 0, "ddos").alias("attack_type"), F.lit("high").alias("risk_level"),
        (F.col("id") % 4 == 0).alias("ai_support"),
    )
    rows = {r.execution_id: r for r in executions(df).collect()}
    hot = df.where("execution_id = 'e0'")
    assert rows["e0"].total_windows == hot.count()
    assert rows["e0"].total_anomalies == hot.where("final_label = 'anomaly'").count()
    assert rows["e0"].attack_type_distribution == {"ddos": hot.where("attack_type = 'ddos'").count(), "unknown": hot.where("attack_type is null").count()}
    totals = live_totals(df).first()
    assert (totals.total_windows, totals.total_alerts, totals.ai_support_count) == (9_000, 4_500, 2_250)
    assert live_totals(df.where("false")).first().total_windows == 0
