from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowguard.operators.rules import analyze_behaviour, flag_map, port_list, refine_with_context, window_instant

SCHEMA = (
    "name string, protocol string, action string, connections double, packets double, packet_size double, ports double, "
    "destination_ip_count long, tcp_syn_count long, tcp_pa_count long, common_destination_ports string, "
    "destination_port_min int, destination_port_max int, blocked_count long"
)


def windows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns(
        {
            "bytes": F.col("packets") * F.col("packet_size"),
            "destination_port_count": F.col("ports").cast("long"),
            "passed_count": F.col("connections").cast("long") - F.col("blocked_count"),
            "tcp_flags_summary": F.lit(""),
        }
    )


def row(name, protocol, action, n, size, ports, dst, syn, pa, listed, blocked):
    numbers = [int(x) for x in listed.split(",") if x]
    return (name, protocol, action, float(n), float(n), float(size), float(ports), dst, syn, pa, listed,
            min(numbers, default=None), max(numbers, default=None), blocked)


CASES = [
    (row("port_scan", "tcp", "block", 200, 60, 180, 1, 180, 0, "1,2,3,4,5,6,7,8,9,10", 200), 0.98),
    (row("syn_flood", "tcp", "block", 40, 44, 1, 1, 40, 0, "80", 40), 0.97),
    (row("ddos", "udp", "pass", 6000, 100, 1, 1, 0, 0, "9999", 0), 0.91),
    (row("brute_force", "tcp", "block", 10, 90, 1, 1, 0, 8, "22", 10), 0.93),
    (row("ssh_suspicious", "tcp", "block", 2, 90, 1, 1, 1, 1, "22", 2), 0.84),
    (row("unknown_anomaly", "tcp", "block", 5, 120, 5, 5, 3, 0, "1000,1001,1002,1003,1004", 5), 0.685 - 0.06 + 0.075),
    (row("normal", "udp", "pass", 4, 80, 1, 1, 0, 0, "53", 0), 0.92),
    (row("normal", "tcp", "pass", 4, 80, 1, 1, 0, 0, "8080", 0), 0.78),
    (row("normal", "icmp", "pass", 3, 84, 0, 1, 0, 0, "", 0), 0.78),
]


def test_rule_fixtures(spark):
    got = analyze_behaviour(windows(spark, [c[0] for c in CASES])).collect()
    for (source, confidence), r in zip(CASES, got):
        assert r.heuristic_attack_type == source[0]
        assert r.heuristic_detected_attack == (source[0] != "normal")
        if source[0] != "unknown_anomaly":
            assert r.heuristic_confidence == pytest.approx(confidence)
    assert got[5].heuristic_confidence == pytest.approx(0.60 + 0.025 + 0.06)


def test_flags_fall_back_to_summary(spark):
    base = windows(spark, [row("x", "tcp", "block", 40, 44, 1, 1, 0, 0, "80", 40)])
    got = analyze_behaviour(base.withColumn("tcp_flags_summary", F.lit("S:30,SYN:10"))).first()
    assert got.heuristic_attack_type == "syn_flood"


def test_text_parsers(spark):
    df = spark.createDataFrame([("22, 80;22x443", "S:10, pa:3,A,A,S:4,x:y"), (None, None)], "p string, f string")
    rows = df.select(port_list(F.col("p")), flag_map(F.col("f"))).collect()
    assert rows[0][0] == [22, 80, 443] and rows[0][1] == {"S": 4, "PA": 3, "A": 2, "X:Y": 1}
    assert rows[1][0] == [] and rows[1][1] == {}


def test_window_instant(spark):
    df = spark.createDataFrame(
        [("bad", "a|2024-01-01T00:00:05|5s"), ("2024-01-02 00:00:00", "z"), (None, "none")], "window_start string, window_id string"
    )
    got = [r[0] for r in df.select(window_instant(df)).collect()]
    assert got == [datetime(2024, 1, 1, 0, 0, 5), datetime(2024, 1, 2), None]


def context_rows(spark, offsets):
    rows = []
    for i, (offset, kind, dst) in enumerate(offsets):
        strong = kind == "strong"
        source = row(kind, "tcp", "block", 10 if strong else 2, 90, 1, 1, 0 if strong else 1, 8 if strong else 1, "22", 10 if strong else 2)
        rows.append(source + (i, "10.0.0.1", dst, None if offset is None else datetime(2024, 1, 1, 0, 1) + timedelta(seconds=offset)))
    df = spark.createDataFrame(rows, SCHEMA + ", idx int, source_ip string, destination_ip_sample string, window_start timestamp")
    return analyze_behaviour(
        df.withColumns(
            {
                "bytes": F.col("packets") * F.col("packet_size"),
                "destination_port_count": F.lit(1),
                "passed_count": F.lit(0),
                "tcp_flags_summary": F.lit(""),
            }
        )
    )


def test_context_promotes_near_windows_only(spark):
    df = context_rows(
        spark,
        [(0, "strong", "d"), (0, "weak", "d"), (60, "weak", "d"), (120, "weak", "d"), (121, "weak", "d"),
         (60, "weak", "e"), (-120, "weak", "d"), (-121, "weak", "d"), (None, "weak", "d")],
    )
    got = {r.idx: r for r in refine_with_context(df).collect()}
    assert len(got) == 9
    assert [i for i in range(1, 9) if got[i].heuristic_attack_type == "brute_force"] == [2, 3, 6]
    assert got[2].heuristic_confidence == pytest.approx(0.90)
    assert got[2].heuristic_reason.endswith("suspeita.")
    by_index = {r.idx: r.heuristic_attack_type for r in refine_with_context(df, index_col="idx").collect()}
    assert by_index[8] == "ssh_suspicious"


def test_context_falls_back_to_row_distance(spark):
    df = context_rows(spark, [(None, "weak", "d"), (0, "strong", "d"), (500, "weak", "d"), (None, "weak", "d")])
    got = {r.idx: r.heuristic_attack_type for r in refine_with_context(df, index_col="idx").collect()}
    assert got == {0: "brute_force", 1: "brute_force", 2: "ssh_suspicious", 3: "ssh_suspicious"}
