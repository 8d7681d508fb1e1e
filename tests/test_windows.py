from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from math import log1p

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowguard.operators.events import eligible, normalise_events
from flowguard.operators.windows import WINDOW_COLUMNS, ordered_windows, window_features, window_seconds

SCHEMA = (
    "seq long, timestamp timestamp, source_ip string, protocol string, action string, interface string, "
    "destination_ip string, destination_port int, tcp_flags string, bytes double, packets double"
)
START = datetime(2024, 1, 1)


def expected(rows, seconds):
    """Independent brute force over ordered rows."""
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[6], r[0])):
        epoch = int((r[1] - START).total_seconds())
        groups[(r[2], START + timedelta(seconds=epoch - epoch % seconds))].append(r)
    out = {}
    for (ip, start), g in groups.items():
        count = lambda i: Counter(r[i] for r in g if r[i] not in (None, ""))
        ports, flags = count(7), count(8)
        b, p = sum(r[9] for r in g), sum(r[10] for r in g)
        out[(ip, start)] = dict(
            event_count=len(g), bytes=b, packets=p, packet_size=b / p if p else 0.0,
            protocol=count(3).most_common(1)[0][0], action=count(4).most_common(1)[0][0],
            interface=count(5).most_common(1)[0][0], destination_ip_sample=count(6).most_common(1)[0][0],
            destination_ip_count=len(count(6)), destination_port_count=len(ports),
            destination_port_min=min(ports, default=None), destination_port_max=max(ports, default=None),
            common_destination_ports=",".join(str(v) for v, _ in ports.most_common(10)),
            tcp_flags_summary=",".join(f"{k}:{n}" for k, n in flags.most_common(5)),
            tcp_syn_count=flags["S"] + flags["SYN"], tcp_pa_count=flags["PA"],
            blocked_count=sum(r[4] == "block" for r in g), passed_count=sum(r[4] == "pass" for r in g),
            log1p_bytes=log1p(b), bytes_per_connection=b / len(g),
        )
    return out


def check(spark, rows, seconds, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = window_features(df, seconds, sequence_col="seq", **options).collect()
    want = expected(rows, seconds)
    assert len(got) == len(want)
    for row in got:
        record = row.asDict()
        for name, value in want[(row.source_ip, row.window_start)].items():
            assert record[name] == pytest.approx(value) if isinstance(value, float) else record[name] == value, name


event = st.tuples(
    st.integers(0, 30),
    st.sampled_from(["10.0.0.1", "10.0.0.2"]),
    st.sampled_from(["tcp", "udp"]),
    st.sampled_from(["block", "pass", "rdr"]),
    st.sampled_from(["em0", "em1"]),
    st.sampled_from(["9.0.0.1", "10.0.0.9", "100.0.0.1", "20.1.1.1"]),
    st.one_of(st.none(), st.integers(1, 14)),
    st.sampled_from(["", "S", "PA", "SYN", "A", "FA", "R"]),
    st.integers(0, 90),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(event, min_size=1, max_size=60))
def test_matches_brute_force(spark, events):
    rows = [
        (i, START + timedelta(seconds=e[0]), e[1], e[2], e[3], e[4], e[5], e[6], e[7], float(e[8]), 1.0)
        for i, e in enumerate(events)
    ]
    for options in ({"addresses": "any"}, {"addresses": "ipv4", "free_flags": False}):
        check(spark, rows, 10, **options)


def test_text_addresses_need_any(spark):
    rows = [(0, START, "::1", "tcp", "block", "em0", "2001:db8::1", 5, "S", 1.0, 1.0)]
    check(spark, rows, 5)
    with pytest.raises(Exception, match="not an IPv4 address"):
        window_features(spark.createDataFrame(rows, SCHEMA), 5, addresses="ipv4").collect()


def test_free_flags_share_one_exchange(spark):
    rows = [(i, START, "10.0.0.1", "tcp", "block", "em0", "1.1.1.1", 5, f"X{i % 7}", 1.0, 1.0) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        windows = window_features(df, 5, sequence_col="seq")
        plan = windows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan
    assert windows.first().tcp_flags_summary == "X0:10,X1:10,X2:10,X3:10,X4:10"
    with pytest.raises(Exception, match="unknown flag text"):
        window_features(df, 5, free_flags=False).collect()


def test_partitioning_does_not_change_windows(spark):
    rows = [
        (i, START + timedelta(seconds=i % 17), f"10.0.0.{i % 3}", "tcp", "block", "em0", "1.1.1.1", i % 40, "S", 50.0, 1.0)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    one = ordered_windows(window_features(df.coalesce(1), 5, sequence_col="seq")).collect()
    many = ordered_windows(window_features(df.repartition(9), 5, sequence_col="seq")).collect()
    assert one == many and list(one[0].asDict()) == WINDOW_COLUMNS
    assert one[0].window_id == "10.0.0.0|2024-01-01T00:00:00|5s"
    assert sum(r.event_count for r in one) == 400


def test_window_lengths():
    assert [window_seconds(w) for w in (None, 7, "5s", "1min", "6h", "30 days", "2 minutes", 60.0)] == [
        5, 7, 5, 60, 21600, 2592000, 120, 60,
    ]
    for bad in (0, -1, 1.5, "x", "1.5s"):
        with pytest.raises(ValueError):
            window_seconds(bad)


def test_normalise(spark):
    df = spark.createDataFrame(
        [
            ("2024-01-01T00:00:00+01:00", " ", "TCP", " Block ", None, None, "80.7", "pa", "-5", None),
            ("bad", "a", "tcp", "pass", "e", "d", "80", "S", "1", "1"),
        ],
        "timestamp string, source_ip string, protocol string, action string, interface string, "
        "destination_ip string, destination_port string, tcp_flags string, bytes string, packets string",
    )
    rows = normalise_events(df).collect()
    assert len(rows) == 1
    assert rows[0].timestamp.replace(tzinfo=timezone.utc) == datetime(2023, 12, 31, 23, tzinfo=timezone.utc)
    assert tuple(rows[0])[1:] == (
        "unknown_source", "tcp", "block", "unknown_interface", "unknown_destination", 80, "PA", 0.0, 1.0,
    )


def test_eligible(spark):
    df = spark.createDataFrame([("full", "firewall"), ("partial", "firewall"), ("full", "unknown")], "parse_status string, log_type string")
    assert eligible(df).count() == 1
    assert eligible(spark.createDataFrame([(True,), (False,), (None,)], "parsed_successfully boolean")).count() == 1
