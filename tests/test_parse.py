import ipaddress
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowguard.functions.scalar import canonical_ip, csv_fields
from flowguard.operators.parse import (
    EVENT_COLUMNS,
    first_errors,
    key_value_features,
    parse_filterlog,
    parse_stats,
    status_counts,
)

V4 = "5,,,1000000103,em0,match,block,in,4,0x0,,64,0,0,none,6,tcp,60,10.0.0.9,192.168.1.1,40000,22,0,S,1,,1024,,"
HEAD = "Jan  5 10:00:00 fw01 filterlog[123]: "
ISO = "2024-01-05T10:00:00Z fw01 filterlog: "


def parse(spark, *lines):
    df = spark.createDataFrame([(i + 1, line) for i, line in enumerate(lines)], "n long, value string")
    rows = parse_filterlog(df, default_year=2024, line_number_col="n").orderBy("line_number").collect()
    return rows[0] if len(lines) == 1 else rows


def test_rfc3164_tcp(spark):
    e = parse(spark, HEAD + V4)
    assert e.timestamp == datetime(2024, 1, 5, 10, 0, 0)
    assert (e.hostname, e.process, e.log_type) == ("fw01", "filterlog[123]", "firewall")
    assert (e.parse_status, e.parsed_successfully, e.error) == ("full", True, None)
    assert (e.source_port, e.destination_port, e.tcp_flags, e.bytes, e.packets) == (40000, 22, "S", 60, 1)
    assert (e.rule, e.subrule, e.anchor, e.tracker) == ("5", None, None, "1000000103")
    assert (e.source_ip, e.destination_ip, e.protocol, e.protocol_id) == ("10.0.0.9", "192.168.1.1", "tcp", 6)
    assert e.csv_payload == V4.strip() and e.is_syslog and e.is_filterlog
    assert set(EVENT_COLUMNS) < set(e.asDict())


def test_iso_udp_and_icmp(spark):
    udp, icmp, offset = parse(
        spark,
        ISO + "5,,,1,em0,match,pass,out,4,0x0,,64,0,0,none,17,udp,76,10.0.0.9,8.8.8.8,50000,53,56",
        ISO + "5,,,1,em0,match,pass,in,4,0x0,,64,0,0,none,1,icmp,84,10.0.0.9,192.168.1.1,request,1",
        "2024-01-05 12:00:00.250+02:00 fw01 filterlog: " + V4,
    )
    assert (udp.parse_status, udp.protocol, udp.destination_port, udp.tcp_flags) == ("full", "udp", 53, None)
    assert (icmp.parse_status, icmp.icmp_type, icmp.icmp_code, icmp.source_port) == ("full", "request", "1", None)
    assert offset.timestamp == datetime(2024, 1, 5, 10, 0, 0, 250000)


def test_ipv6_both_orders(spark):
    head = ISO + "5,,,1,em0,match,block,in,6,0x00,0,64,"
    tail = ",40,2001:DB8:0:0:0:0:0:1,2001:db8::2,40000,443,0,S"
    a, b = parse(spark, head + "6,tcp" + tail, head + "udp,17" + tail)
    assert (a.protocol, a.protocol_id, a.source_ip, a.tcp_flags) == ("tcp", 6, "2001:db8::1", "S")
    assert (b.protocol, b.protocol_id, b.source_port, b.destination_port) == ("udp", 17, 40000, 443)


def test_protocol_fallbacks_and_ports(spark):
    def v4(pid, proto, dport):
        return ISO + f"5,,,1,em0,match,pass,in,4,0x0,,64,0,0,none,{pid},{proto},60,10.0.0.9,10.0.0.1,4000,{dport},0"

    a, b, c, d = parse(spark, v4(17, "", 53), v4(47, "", 53), v4(17, "udp", ""), v4(6, "TCP", 70000))
    assert (a.protocol, b.protocol) == ("udp", "47")
    assert b.parse_status == "full" and b.source_port is None
    for e in (c, d):
        assert e.parse_status == "partial" and "destination_port" in e.error and "source_port" not in e.error
    assert d.protocol == "tcp"


def test_failed_routes(spark):
    v5, short, other, bare, garbage = parse(
        spark,
        HEAD + V4.replace(",in,4,", ",in,5,"),
        HEAD + "a,b,c",
        "Jan  5 10:00:00 fw01 sshd[1]: Accepted",
        V4,
        "hello",
    )
    assert (v5.parse_status, v5.log_type) == ("failed", "firewall") and "nao encontrado" in v5.error
    assert (short.parse_status, short.log_type) == ("failed", "firewall") and "nao encontrado" in short.error
    assert (other.log_type, other.parse_status, other.process) == ("syslog_other", "failed", "sshd[1]")
    assert (bare.log_type, bare.parse_status, bare.timestamp, bare.is_syslog) == ("firewall", "full", None, False)
    assert (garbage.log_type, garbage.parse_status) == ("unknown", "failed")


def test_prefix_inside_message(spark):
    ok, short, version, empty = parse(
        spark,
        "Jan  5 10:00:00 fw01 relay: FilterLog[9]: " + V4,
        "Jan  5 10:00:00 fw01 relay: filterlog: a,b,c",
        "Jan  5 10:00:00 fw01 relay: filterlog: " + V4.replace(",in,4,", ",in,5,"),
        "Jan  5 10:00:00 fw01 relay: filterlog:   ",
    )
    assert ok.parse_status == "full" and ok.csv_payload == V4
    assert "muito curto" in short.error
    assert "Versao IP" in version.error and version.interface == "em0" and version.bytes is None
    assert "nao encontrado" in empty.error


def test_quotes_blank_and_bad_date(spark):
    rows = parse(
        spark,
        HEAD + V4.replace("em0", '"em0,vlan1"'),
        "   ",
        HEAD.replace("Jan  5", "Xyz 45") + V4,
    )
    assert [r.line_number for r in rows] == [1, 3]
    assert rows[0].interface == "em0,vlan1" and rows[0].parse_status == "full"
    assert rows[1].timestamp is None and rows[1].timestamp_text == "Xyz 45 10:00:00"


def test_csv_split_matches_csv_module(spark):
    import csv
    import io

    texts = ["a,,b", ",", '"a,b",c', '"a""b",c', 'a"b,"c', '"ab"cd,e', '"open,x', '', 'x, "y",z', '"",""', '"a"b"c,d']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(csv_fields(F.col("t"))).collect()]
    want = [next(csv.reader(io.StringIO(t)), [""]) for t in texts]
    assert got == [w or [""] for w in want]


@pytest.mark.parametrize("mapped", [False])
def test_ipv6_text_matches_stdlib(spark, mapped):
    texts = [
        "2001:DB8:0:0:0:0:0:1", "::", "::1", "1::", "fe80::1%eth0", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4",
        "0:0:0:0:0:0:0:0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2001:db8::0:1", "1:0:3:4:5:6:7:8",
        "::1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.256", "::01.2.3.4", "1:::2", "1::2::3", "12345::", "g::",
        "1:2:3", ":1:2:3:4:5:6:7", "10.0.0.1", "text", "1:2:3:4:5:6:7:8:9", "0001:0010::00ff", ":", "a:b",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(canonical_ip(F.col("t"))).collect()]

    def reference(t):
        try:
            return str(ipaddress.ip_address(t))
        except ValueError:
            return t

    assert got == [reference(t) for t in texts]


def test_stats_and_errors(spark):
    df = spark.createDataFrame([(1, HEAD + V4), (2, "hello"), (3, HEAD + "x"), (4, "z")], "n long, value string")
    ev = parse_filterlog(df, default_year=2024, line_number_col="n")
    s = parse_stats(ev).first()
    assert (s.total_lines, s.parsed_successfully, s.parse_failures, s.full_count, s.failed_count) == (4, 1, 3, 1, 3)
    assert {r.parse_status: r.n for r in status_counts(ev).collect()} == {"full": 1, "failed": 3}
    assert [r.line_number for r in first_errors(ev, limit=2).collect()] == [2, 3]


def test_key_value(spark):
    df = spark.createDataFrame(
        [("conn=10 total_bytes=500 dst_port=80",), ("Bytes = 1.5 bytes=7 foo=3 port=1 ports=2",), ("nothing",)],
        "value string",
    )
    rows = [tuple(r) for r in key_value_features(df).collect()]
    assert rows == [(10.0, 500.0, 0.0, 0.0, 80.0), (0.0, 7.0, 0.0, 0.0, 2.0), (0.0,) * 5]
