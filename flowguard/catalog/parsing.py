"""Parser queries over lines written from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog.tables import FW, dealt, fw, fw_of, lines
from flowguard.functions.scalar import with_pinned
from flowguard.operators.events import eligible, normalise_events, prepare_events
from flowguard.operators.parse import first_errors, key_value_features, parse_filterlog, parse_stats, status_counts

YEAR = 2024


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_filterlog(lines(spark, folder), default_year=YEAR, line_number_col="event_id", keep=("event_id",))


def mixed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Good lines, a missing port, a wrong address family, another process, no header."""
    kind = F.col("event_id") % 6
    good = F.col("value")
    return lines(spark, folder).select(
        "event_id",
        F.when(kind == 0, good)
        .when(kind == 1, F.regexp_replace(good, ",40000,", ",,"))
        .when(kind == 2, F.regexp_replace(good, ",in,4,", ",in,5,"))
        .when(kind == 3, F.concat(F.lit("Jan  5 10:00:00 fw01 sshd[1]: Accepted "), F.col("event_id").cast("string")))
        .when(kind == 4, F.concat(F.lit("hello "), F.col("event_id").cast("string")))
        .otherwise(F.regexp_extract(good, r"\]: (.*)$", 1))
        .alias("value"),
    )


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_filterlog(mixed_lines(spark, folder), default_year=YEAR, line_number_col="event_id", keep=("event_id",))


def ipv6_lines(spark: SparkSession, folder: str) -> DataFrame:
    tail = F.concat(
        F.lit(",40,2001:DB8:0:0:0:0:0:"), (F.col("event_id") % 8).cast("string"),
        F.lit(",fe80::0:0:"), F.lower(F.hex(F.col("event_id") % 5 + 1)), F.lit(",40000,"),
        (F.col("event_id") % 1000).cast("string"), F.lit(",0,s"),
    )
    order = F.when(F.col("event_id") % 2 == 0, "6,TCP").otherwise("udp,17")
    value = F.concat(
        F.lit("Jan "), F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, " "),
        F.lit(" 10:00:00 fw01 filterlog: 5,,,1,em0,match,BLOCK,in,6,0x00,0,64,"), order, tail,
    )
    return with_pinned(fw_of(dealt(spark, folder)), "value", value).select("event_id", "value")


def parse_header(spark, folder):
    return parsed(spark, folder).select("event_id", "timestamp", "hostname", "process", "log_type", "is_syslog", "is_filterlog")


def parse_ipv4(spark, folder):
    return parsed(spark, folder).select(
        "event_id", "rule", "subrule", "tracker", "interface", "reason", "action", "direction", "ip_version",
        "protocol_id", "protocol", "length", "source_ip", "destination_ip", "bytes", "packets",
    )


def parse_ipv6(spark, folder):
    return parse_filterlog(ipv6_lines(spark, folder), default_year=YEAR, keep=("event_id",)).select(
        "event_id", "timestamp", "ip_version", "protocol_id", "protocol", "length", "action", "source_port",
        "destination_port", "tcp_flags", "parse_status",
    )


def parse_ipv6_text(spark, folder):
    return parse_filterlog(ipv6_lines(spark, folder), default_year=YEAR, keep=("event_id",)).select(
        "event_id", "source_ip", "destination_ip"
    )


def parse_ports(spark, folder):
    return parsed(spark, folder).select("event_id", "source_port", "destination_port")


def parse_flags(spark, folder):
    return parsed(spark, folder).select("event_id", "tcp_flags")


def parse_icmp(spark, folder):
    return parsed(spark, folder).select("event_id", "icmp_type", "icmp_code")


def parse_status(spark, folder):
    return mixed(spark, folder).select("event_id", "log_type", "parse_status", "parsed_successfully", "error")


def parse_totals(spark, folder):
    return parse_stats(mixed(spark, folder))


def parse_status_counts(spark, folder):
    return status_counts(mixed(spark, folder))


def parse_diagnostics(spark, folder):
    return first_errors(mixed(spark, folder)).select("line_number", "parse_status", "error")


def kv_features(spark, folder):
    records = fw(spark, folder).select(
        "event_id",
        F.concat(
            F.lit("conn="), F.col("event_id").cast("string"), F.lit(" bytes=1 total_bytes = "),
            F.col("bytes").cast("int").cast("string"), F.lit(".5 dst_port="),
            F.coalesce(F.col("destination_port").cast("string"), F.lit("none")), F.lit(" other=7"),
        ).alias("value"),
    )
    return key_value_features(records, keep=("event_id",))


def events_eligible(spark, folder):
    return eligible(mixed(spark, folder)).select("event_id", "source_ip", "protocol")


def events_normalised(spark, folder):
    raw = fw(spark, folder).select(
        "event_id",
        F.when(F.col("event_id") % 11 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" "), "source_ip", F.lit(" "))).alias("source_ip"),
        F.upper("protocol").alias("protocol"),
        F.when(F.col("event_id") % 5 != 0, F.upper("action")).otherwise("  ").alias("action"),
        F.lit(None).cast("string").alias("interface"),
        "destination_ip",
        (F.col("destination_port") * 70).alias("destination_port"),
        F.lower("tcp_flags").alias("tcp_flags"),
        (F.col("bytes") - 60).alias("bytes"),
        F.when(F.col("event_id") % 2 == 0, F.col("packets")).alias("packets"),
    )
    return normalise_events(raw, keep=("event_id",))


def events_prepared(spark, folder):
    return prepare_events(parsed(spark, folder), keep=("event_id",))



def parse_variants(spark, folder):
    """The payload behind a prefix inside another message, and quoted fields with commas in them."""
    rows = lines(spark, folder)
    kind = F.col("event_id") % 3
    inside = F.regexp_replace("value", r" filterlog\[(\d+)\]: ", " relay[7]: filterlog[$1]: ")
    quoted = F.regexp_replace("value", ",match,", ',"ma,tch",')
    text = F.when(kind == 0, inside).when(kind == 1, quoted).otherwise(F.col("value"))
    parsed = parse_filterlog(rows.select("event_id", text.alias("value")).where("value IS NOT NULL"), default_year=2024, line_number_col="event_id")
    return parsed.select(F.col("line_number").alias("event_id"), "process", "is_filterlog", "interface", "reason", "action", "source_ip", F.col("length").alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_header, parse_ipv4, parse_ipv6, parse_ipv6_text, parse_ports, parse_flags, parse_icmp, parse_status,
        parse_totals, parse_status_counts, parse_diagnostics, kv_features, events_eligible, events_normalised,
        events_prepared, parse_variants,
    )
}

_FW = f"WITH fw AS ({FW})"
_MIXED = f"""
{_FW}, m AS (
 SELECT *, event_id % 6 AS kind,
  CASE WHEN event_id % 6 = 0 THEN 'full'
       WHEN event_id % 6 = 1 AND protocol IN ('tcp','udp') THEN 'partial'
       WHEN event_id % 6 = 1 THEN 'full'
       WHEN event_id % 6 = 5 THEN 'full' ELSE 'failed' END AS base_status,
  protocol IN ('tcp','udp') AND destination_port IS NULL AS no_port
 FROM fw),
s AS (
 SELECT event_id, source_ip, protocol,
  CASE WHEN kind IN (0,1,2,5) THEN 'firewall' WHEN kind = 3 THEN 'syslog_other' ELSE 'unknown' END AS log_type,
  base_status AS parse_status,
  CASE WHEN kind = 2 THEN 'Payload CSV do filterlog nao encontrado.'
       WHEN kind = 3 THEN 'Linha syslog lida, mas nao corresponde ao filterlog do pfSense.'
       WHEN kind = 4 THEN 'Linha nao reconhecida como syslog ou payload de filterlog.'
       WHEN base_status = 'partial' THEN 'Campos obrigatorios ausentes para parse completo: source_port.' END AS error
 FROM m)
"""
ORACLES = {
    "parse_variants": f"""{_FW} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'relay[7]' ELSE concat('filterlog[', event_id, ']') END AS process, true AS is_filterlog,
 interface, CASE WHEN event_id % 3 = 1 THEN 'ma,tch' ELSE 'match' END AS reason, action, source_ip, CAST(bytes AS BIGINT) AS size FROM fw""",
    "parse_header": f"""{_FW} SELECT event_id, date_trunc('second', timestamp) AS timestamp, 'fw01' AS hostname,
 concat('filterlog[', event_id, ']') AS process, 'firewall' AS log_type, true AS is_syslog, true AS is_filterlog FROM fw""",
    "parse_ipv4": f"""{_FW} SELECT event_id, '5' AS rule, CAST(NULL AS VARCHAR) AS subrule, '1000000103' AS tracker,
 interface, 'match' AS reason, action, 'in' AS direction, 4 AS ip_version,
 CASE protocol WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 ELSE 1 END AS protocol_id, protocol,
 CAST(bytes AS INT) AS length, source_ip, destination_ip, CAST(bytes AS INT) AS bytes, 1 AS packets FROM fw""",
    "parse_ipv6": """SELECT event_id, make_timestamp(2024, 1, event_id % 28 + 1, 10, 0, 0) AS timestamp, 6 AS ip_version,
 CASE WHEN event_id % 2 = 0 THEN 6 ELSE 17 END AS protocol_id,
 CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, 40 AS length, 'block' AS action, 40000 AS source_port,
 CAST(event_id % 1000 AS INT) AS destination_port, CASE WHEN event_id % 2 = 0 THEN 'S' END AS tcp_flags,
 'full' AS parse_status FROM events""",
    "parse_ipv6_text": """SELECT event_id,
 CASE WHEN event_id % 8 = 0 THEN '2001:db8::' ELSE concat('2001:db8::', event_id % 8) END AS source_ip,
 concat('fe80::', event_id % 5 + 1) AS destination_ip FROM events""",
    "parse_ports": f"""{_FW} SELECT event_id, CASE WHEN protocol <> 'icmp' THEN 40000 END AS source_port,
 CASE WHEN protocol <> 'icmp' THEN destination_port END AS destination_port FROM fw""",
    "parse_flags": f"""{_FW} SELECT event_id, CASE WHEN protocol = 'tcp' THEN nullif(tcp_flags, '') END AS tcp_flags FROM fw""",
    "parse_icmp": f"""{_FW} SELECT event_id, CASE WHEN protocol = 'icmp' THEN 'request' END AS icmp_type,
 CASE WHEN protocol = 'icmp' THEN '1' END AS icmp_code FROM fw""",
    "parse_status": f"""{_MIXED} SELECT event_id, log_type, parse_status, parse_status = 'full' AS parsed_successfully, error FROM s""",
    "parse_totals": f"""{_MIXED} SELECT count(*) AS total_lines, count(*) FILTER (parse_status = 'full') AS parsed_successfully,
 count(*) FILTER (parse_status <> 'full') AS parse_failures, count(*) FILTER (parse_status = 'full') AS full_count,
 count(*) FILTER (parse_status = 'partial') AS partial_count, count(*) FILTER (parse_status = 'failed') AS failed_count FROM s""",
    "parse_status_counts": f"{_MIXED} SELECT parse_status, count(*) AS n FROM s GROUP BY parse_status",
    "parse_diagnostics": f"""{_MIXED} SELECT event_id AS line_number, parse_status, error FROM s WHERE error IS NOT NULL
 ORDER BY event_id LIMIT 5""",
    "kv_features": f"""{_FW} SELECT event_id, CAST(event_id AS DOUBLE) AS connections, CAST(bytes AS INT) + CAST(0.5 AS DOUBLE) AS bytes,
 CAST(0 AS DOUBLE) AS packets, CAST(0 AS DOUBLE) AS packet_size, CAST(coalesce(destination_port, 0) AS DOUBLE) AS ports FROM fw""",
    "events_eligible": f"""{_MIXED} SELECT event_id, source_ip, protocol FROM s
 WHERE parse_status = 'full' AND log_type = 'firewall'""",
    "events_normalised": f"""{_FW} SELECT event_id, timestamp,
 CASE WHEN event_id % 3 <> 0 THEN source_ip ELSE 'unknown_source' END AS source_ip, protocol,
 CASE WHEN event_id % 5 <> 0 THEN action ELSE 'unknown_action' END AS action, 'unknown_interface' AS interface, destination_ip,
 CASE WHEN destination_port * 70 BETWEEN 0 AND 65535 THEN destination_port * 70 END AS destination_port, tcp_flags,
 greatest(bytes - 60, 0) AS bytes, CAST(1 AS DOUBLE) AS packets FROM fw WHERE event_id % 11 <> 0""",
    "events_prepared": f"""{_FW} SELECT event_id, date_trunc('second', timestamp) AS timestamp, source_ip, protocol, action, interface,
 destination_ip, CASE WHEN protocol <> 'icmp' THEN destination_port END AS destination_port,
 CASE WHEN protocol = 'tcp' THEN tcp_flags ELSE '' END AS tcp_flags, bytes, packets FROM fw""",
}
