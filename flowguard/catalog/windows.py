"""Window queries over ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.catalog import tables
from flowguard.catalog.tables import FW, SCAN
from flowguard.operators.rules import analyze_behaviour
from flowguard.operators.windows import ordered_windows, window_features

WINDOW_6H = "6h"
WINDOW_30D = "30 days"


def fw_windows(spark, folder):
    return window_features(tables.fw(spark, folder), WINDOW_6H, sequence_col="event_id", addresses="ipv4", free_flags=False)


def scan_windows(spark, folder):
    return window_features(tables.scan(spark, folder), WINDOW_30D, sequence_col="event_id", addresses="ipv4", free_flags=False)


def window_core(spark, folder):
    return fw_windows(spark, folder).select(
        "window_id", "source_ip", "window_start", "window_end", "event_count", "bytes", "packets", "packet_size",
        "blocked_count", "passed_count",
    )


def window_distinct(spark, folder):
    return scan_windows(spark, folder).select(
        "window_id", "destination_ip_count", "destination_port_count", "destination_port_min", "destination_port_max",
    )


def window_modes(spark, folder):
    return fw_windows(spark, folder).select("window_id", "protocol", "action", "interface", "destination_ip_sample")


def window_topk_ports(spark, folder):
    return scan_windows(spark, folder).select("window_id", "common_destination_ports")


def window_flags(spark, folder):
    return fw_windows(spark, folder).select("window_id", "tcp_syn_count", "tcp_pa_count", "tcp_flags_summary")


def window_flags_free(spark, folder):
    events = tables.fw(spark, folder).withColumn(
        "tcp_flags", F.concat("tcp_flags", (F.col("event_id") % 9).cast("string"))
    )
    windows = window_features(events, WINDOW_6H, sequence_col="event_id", free_flags=True)
    return windows.select("window_id", "tcp_flags_summary")


def window_null_action(spark, folder):
    """Totals keep the events that have no action or protocol."""
    missing = F.col("event_id") % 4 == 0
    events = tables.fw(spark, folder).withColumn("action", F.when(~missing, F.col("action"))).withColumn("protocol", F.when(missing, "").otherwise(F.col("protocol")))
    windows = window_features(events, WINDOW_6H, sequence_col="event_id", addresses="ipv4", free_flags=False)
    return windows.select("source_ip", "window_start", "event_count", "bytes", "blocked_count", "passed_count")


def window_full(spark, folder):
    windows = ordered_windows(fw_windows(spark, folder))
    rounded = {n: F.round(n, 9) for n in V.LOG_FEATURES}
    return windows.withColumns(rounded).drop("time_window", "src_ip")


def attack_distribution(spark, folder):
    """Attack families of dense and sparse windows: parse-free end-to-end slice."""
    both = fw_windows(spark, folder).unionByName(scan_windows(spark, folder))
    return analyze_behaviour(both).groupBy("heuristic_attack_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        window_core, window_distinct, window_modes, window_topk_ports, window_flags, window_flags_free, window_null_action,
        window_full, attack_distribution,
    )
}


def windows_sql(events: str, bucket: str, seconds: int) -> str:
    """Window table of an events query in SQL."""
    union = " UNION ALL ".join(
        f"SELECT ws, source_ip, '{a}' AS a, CAST({a} AS VARCHAR) AS v, timestamp, destination_ip AS d, event_id FROM e"
        for a in ("protocol", "action", "interface", "destination_ip", "destination_port", "tcp_flags")
    )
    pick = "max(v) FILTER (a = '{0}' AND rn = 1) AS {1}"
    picks = ", ".join(
        pick.format(a, n)
        for a, n in (("protocol", "protocol"), ("action", "action"), ("interface", "interface"), ("destination_ip", "destination_ip_sample"))
    )
    return f"""
WITH src AS ({events}), e AS (SELECT *, {bucket} AS ws FROM src),
b AS (
 SELECT ws, source_ip, count(*) AS event_count, sum(bytes) AS bytes, sum(packets) AS packets,
  count(DISTINCT destination_ip) AS destination_ip_count, count(DISTINCT destination_port) AS destination_port_count,
  min(destination_port) AS destination_port_min, max(destination_port) AS destination_port_max,
  count(*) FILTER (tcp_flags IN ('S','SYN')) AS tcp_syn_count, count(*) FILTER (tcp_flags = 'PA') AS tcp_pa_count,
  count(*) FILTER (action = 'block') AS blocked_count, count(*) FILTER (action = 'pass') AS passed_count
 FROM e GROUP BY ws, source_ip),
x AS (SELECT *, row_number() OVER (PARTITION BY ws, source_ip, a, v ORDER BY timestamp, d, event_id) AS place FROM ({union}) WHERE v <> ''),
c AS (SELECT ws, source_ip, a, v, count(*) AS n, min(timestamp) AS t, min(d) FILTER (place = 1) AS d, min(event_id) FILTER (place = 1) AS s
 FROM x GROUP BY ws, source_ip, a, v),
r AS (SELECT *, row_number() OVER (PARTITION BY ws, source_ip, a ORDER BY n DESC, t, d, s) AS rn FROM c),
m AS (SELECT ws, source_ip, {picks},
  coalesce(string_agg(v, ',' ORDER BY rn) FILTER (a = 'destination_port' AND rn <= 10), '') AS common_destination_ports,
  coalesce(string_agg(concat(v, ':', n), ',' ORDER BY rn) FILTER (a = 'tcp_flags' AND rn <= 5), '') AS tcp_flags_summary
 FROM r GROUP BY ws, source_ip)
SELECT concat(b.source_ip, '|', strftime(b.ws, '%Y-%m-%dT%H:%M:%S'), '|{seconds}s') AS window_id,
 b.ws AS window_start, b.ws + INTERVAL {seconds} SECOND AS window_end, b.source_ip AS source_ip, event_count,
 protocol, action, interface, destination_ip_count, destination_ip_sample, destination_port_min, destination_port_max,
 destination_port_count, common_destination_ports, tcp_syn_count, tcp_pa_count, tcp_flags_summary, blocked_count,
 passed_count, CAST(event_count AS DOUBLE) AS connections, bytes, packets,
 CASE WHEN packets > 0 THEN bytes / packets ELSE 0 END AS packet_size,
 CAST(destination_port_count AS DOUBLE) AS ports,
 CASE WHEN packets <> 0 THEN bytes / packets ELSE 0 END AS bytes_per_packet, bytes / event_count AS bytes_per_connection,
 packets / event_count AS packets_per_connection
FROM b JOIN m ON b.ws = m.ws AND b.source_ip = m.source_ip
"""


MODES_SQL = windows_sql(FW, "time_bucket(INTERVAL '6 hours', timestamp)", 21600)
SCAN_SQL = windows_sql(SCAN, "time_bucket(INTERVAL '30 days', timestamp, TIMESTAMP '1970-01-01')", 2592000)
_FREE = f"SELECT * REPLACE (concat(tcp_flags, event_id % 9) AS tcp_flags) FROM ({FW})"
FREE_SQL = windows_sql(_FREE, "time_bucket(INTERVAL '6 hours', timestamp)", 21600)

RULES = """
p AS (SELECT *, list_transform(list_filter(string_split(common_destination_ports, ','), lambda x: x <> ''), lambda x: CAST(x AS INT)) AS pl FROM w),
q AS (SELECT *, CASE WHEN len(pl) > 0 THEN pl ELSE list_filter(list_distinct([destination_port_min, destination_port_max]), lambda x: x > 0) END AS ps,
  greatest(CAST(round(packets) AS BIGINT), 1) AS den FROM p),
h AS (SELECT *, greatest(destination_port_count, CAST(round(ports) AS BIGINT), len(ps)) AS pc,
  tcp_syn_count / den AS syn_r, tcp_pa_count / den AS pa_r,
  (action = 'block' OR blocked_count > 0 OR blocked_count / den >= 0.5) AS bl,
  len(ps) > 0 AND len(list_filter(ps, lambda x: NOT list_contains([53,80,123,443], x))) = 0 AS safe_only,
  list_has_any(ps, [21,22,23,25,110,143,445,3389]) AS sens, list_contains(ps, 22) AS ssh FROM q),
k AS (SELECT *,
  CASE WHEN protocol='tcp' AND pc >= 50 AND syn_r >= 0.65 AND connections >= greatest(20, pc * 0.70) AND packet_size <= 90
   THEN round(least(0.98, 0.86 + least(pc / 2000, 0.07) + least(connections / 2000, 0.04) + CASE WHEN destination_ip_count <= 3 THEN 0.02 ELSE 0 END), 4) END AS c1,
  CASE WHEN protocol='tcp' AND tcp_syn_count >= 4 AND syn_r >= 0.75 AND packet_size <= 60 AND pc <= 3 AND destination_ip_count <= 3 AND bl
   THEN round(least(0.97, 0.84 + least(tcp_syn_count / 40, 0.08) + CASE WHEN blocked_count >= 4 THEN 0.03 ELSE 0 END + CASE WHEN pc = 1 THEN 0.02 ELSE 0 END), 4) END AS c2,
  CASE WHEN packets >= 5000 OR bytes >= 500000 OR (connections >= 400 AND packets_per_connection >= 8) OR (connections >= 600 AND bytes_per_connection >= 400)
   THEN round(least(0.96, 0.72 + CASE WHEN packets >= 5000 THEN 0.08 ELSE 0 END + CASE WHEN bytes >= 500000 THEN 0.08 ELSE 0 END
     + CASE WHEN packets_per_connection >= 8 THEN 0.05 ELSE 0 END + CASE WHEN connections >= 600 THEN 0.03 ELSE 0 END), 4) END AS c3,
  CASE WHEN protocol='tcp' AND sens AND bl AND (tcp_pa_count >= 4 OR (tcp_syn_count >= 4 AND packets >= 6))
   THEN round(least(0.93, 0.78 + CASE WHEN ssh THEN 0.08 ELSE 0 END + least(tcp_pa_count / 20, 0.05) + CASE WHEN packets >= 8 THEN 0.02 ELSE 0 END), 4) END AS c4,
  CASE WHEN protocol='tcp' AND sens AND bl AND NOT (tcp_pa_count >= 4 OR (tcp_syn_count >= 4 AND packets >= 6)) AND (tcp_pa_count >= 1 OR tcp_syn_count >= 2 OR packets >= 2)
   THEN round(least(0.86, 0.72 + CASE WHEN ssh THEN 0.06 ELSE 0 END + least(pa_r, 0.04) + CASE WHEN blocked_count >= 2 THEN 0.02 ELSE 0 END), 4) END AS c5
 FROM h),
z AS (SELECT *, greatest(c1, c2, c3, c4, c5) AS best,
  bl AND NOT safe_only AND (tcp_syn_count >= 3 OR tcp_pa_count >= 3 OR pc >= 20) AS odd,
  action = 'pass' AND blocked_count = 0 AND passed_count >= 1 AND pc <= 10 AND safe_only
   AND NOT (protocol='tcp' AND tcp_syn_count >= 8 AND pc <= 3 AND destination_ip_count <= 3 AND packet_size <= 60) AS benign FROM k),
verdict AS (SELECT *,
  CASE WHEN c1 = best THEN 'port_scan' WHEN c2 = best THEN 'syn_flood' WHEN c3 = best THEN 'ddos' WHEN c4 = best THEN 'brute_force'
   WHEN c5 = best THEN 'ssh_suspicious' WHEN odd THEN 'unknown_anomaly' ELSE 'normal' END AS heuristic_attack_type,
  CASE WHEN best IS NOT NULL THEN best
   WHEN odd THEN round(least(0.80, 0.60 + least(pc / 200, 0.08) + least(tcp_syn_count / 40, 0.06) + least(tcp_pa_count / 20, 0.06)), 4)
   WHEN benign THEN 0.92 ELSE 0.78 END AS heuristic_confidence FROM z)
"""


def rules_sql(windows: str, select: str) -> str:
    return f"WITH w AS ({windows}), {RULES.strip()} {select}"


ORACLES = {
    "window_core": f"SELECT window_id, source_ip, window_start, window_end, event_count, bytes, packets, packet_size, blocked_count, passed_count FROM ({MODES_SQL})",
    "window_distinct": f"SELECT window_id, destination_ip_count, destination_port_count, destination_port_min, destination_port_max FROM ({SCAN_SQL})",
    "window_modes": f"SELECT window_id, protocol, action, interface, destination_ip_sample FROM ({MODES_SQL})",
    "window_topk_ports": f"SELECT window_id, common_destination_ports FROM ({SCAN_SQL})",
    "window_flags": f"SELECT window_id, tcp_syn_count, tcp_pa_count, tcp_flags_summary FROM ({MODES_SQL})",
    "window_null_action": f"""WITH src AS ({FW}), e AS (SELECT *, time_bucket(INTERVAL '6 hours', timestamp, TIMESTAMP '1970-01-01') AS ws FROM src)
SELECT source_ip, ws AS window_start, count(*) AS event_count, sum(bytes) AS bytes, count(*) FILTER (action = 'block' AND event_id % 4 <> 0) AS blocked_count,
 count(*) FILTER (action = 'pass' AND event_id % 4 <> 0) AS passed_count FROM e GROUP BY source_ip, ws""",
    "window_flags_free": f"SELECT window_id, tcp_flags_summary FROM ({FREE_SQL})",
    "window_full": f"""SELECT *, round(ln(1 + connections), 9) AS log1p_connections, round(ln(1 + bytes), 9) AS log1p_bytes,
 round(ln(1 + packets), 9) AS log1p_packets, round(ln(1 + packet_size), 9) AS log1p_packet_size, round(ln(1 + ports), 9) AS log1p_ports
 FROM ({MODES_SQL}) ORDER BY window_start, source_ip""",
    "attack_distribution": rules_sql(
        f"SELECT * FROM ({MODES_SQL}) UNION ALL SELECT * FROM ({SCAN_SQL})",
        "SELECT heuristic_attack_type, count(*) AS n FROM verdict GROUP BY heuristic_attack_type",
    ),
}
