"""Behaviour rules over a window row, and the SSH neighbour-window correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard import vocabulary as V

CORRELATION_SECONDS = 120
MIN_ANCHOR_BLOCKED = 4
MIN_WEAK_BLOCKED = 2


def port_list(text: Column) -> Column:
    """distinct integers found in a text."""
    found = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"([0-9]+)"), 1)
    return F.array_compact(F.array_distinct(F.transform(found, lambda x: x.try_cast("int"))))


def _flag_tokens(text: Column) -> Column:
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t))
    return F.transform(
        F.filter(tokens, lambda t: t != ""),
        lambda t: F.struct(
            F.upper(
                F.when(_counted(t), F.trim(F.substring_index(t, ":", 1))).otherwise(t)
            ).alias("name"),
            F.when(_counted(t), _after_colon(t).try_cast("int")).alias("count"),
        ),
    )


def _after_colon(token: Column) -> Column:
    return F.trim(F.regexp_extract(token, "^[^:]*:(.*)$", 1))


def _counted(token: Column) -> Column:
    return token.contains(":") & _after_colon(token).rlike(r"^[+-]?\d+$")


def _fold_flag(tokens: Column, name: Column) -> Column:
    """Later ``name:count`` replaces; a bare ``name`` adds one."""
    return F.aggregate(
        F.filter(tokens, lambda t: t["name"] == name),
        F.lit(0),
        lambda total, t: F.coalesce(t["count"], total + 1),
    )


def flag_count(text: Column, name: str) -> Column:
    return _fold_flag(_flag_tokens(text), F.lit(name))


def flag_map(text: Column) -> Column:
    """flag summary text as a map."""
    tokens = _flag_tokens(text)
    names = F.array_distinct(F.transform(tokens, lambda t: t["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: _fold_flag(tokens, n)))


def _value(df: DataFrame, name: str) -> Column:
    """Numeric column, zero when absent, null or not a number."""
    if name not in df.columns:
        return F.lit(0.0)
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        value = value.try_cast("double")
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def _count(df: DataFrame, name: str) -> Column:
    return F.bround(_value(df, name)).cast("long")


def _text(df: DataFrame, *names: str) -> Column:
    present = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.lower(F.coalesce(*present, F.lit("")))


def _either(value: Column, fallback: Column) -> Column:
    return F.when(value != 0, value).otherwise(fallback)


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _any_port(ports: Column, wanted: list[int]) -> Column:
    return F.arrays_overlap(ports, F.array(*[F.lit(p) for p in wanted]))


def _signals(df: DataFrame) -> DataFrame:
    """Inputs of the rules as ``_h_*`` columns."""
    listed = port_list(F.col("common_destination_ports")) if "common_destination_ports" in df.columns else F.array().cast("array<int>")
    bounds = F.array_distinct(
        F.filter(
            F.array(*[_count(df, f"destination_port_{x}").cast("int") for x in ("min", "max")]), lambda p: p > 0
        )
    )
    flags = F.col("tcp_flags_summary") if "tcp_flags_summary" in df.columns else F.lit("")
    syn, pa = _count(df, "tcp_syn_count"), _count(df, "tcp_pa_count")
    df = df.withColumns(
        {
            **{f"_h_{n}": _value(df, n) for n in V.BASE_FEATURES},
            "_h_listed": listed,
            "_h_protocol": _text(df, "protocol"),
            "_h_action": _text(df, "action"),
            "_h_destinations": _count(df, "destination_ip_count"),
            "_h_blocked": _count(df, "blocked_count"),
            "_h_passed": _count(df, "passed_count"),
            "_h_syn": F.when(syn > 0, syn).otherwise(flag_count(flags, "S") + flag_count(flags, "SYN")),
            "_h_pa": F.when(pa > 0, pa).otherwise(flag_count(flags, "PA")),
        }
    )
    df = df.withColumn("_h_set", F.when(F.size("_h_listed") > 0, F.col("_h_listed")).otherwise(bounds))
    packets = F.greatest(F.bround("_h_packets").cast("long"), F.lit(1))
    return df.withColumns(
        {
            "_h_port_count": F.greatest(
                _count(df, "destination_port_count"), F.bround("_h_ports").cast("long"), F.size("_h_set").cast("long")
            ),
            "_h_bpc": _either(_value(df, "bytes_per_connection"), _over(F.col("_h_bytes"), F.col("_h_connections"))),
            "_h_ppc": _either(_value(df, "packets_per_connection"), _over(F.col("_h_packets"), F.col("_h_connections"))),
            "_h_syn_ratio": F.col("_h_syn") / packets,
            "_h_pa_ratio": F.col("_h_pa") / packets,
            "_h_is_blocked": (F.col("_h_action") == "block")
            | (F.col("_h_blocked") > 0)
            | (F.col("_h_blocked") / packets >= 0.50),
            "_h_safe_only": (F.size("_h_set") > 0)
            & (F.size(F.array_except("_h_set", F.array(*[F.lit(p) for p in V.SAFE_PORTS]))) == 0),
            "_h_sensitive": _any_port(F.col("_h_set"), V.SENSITIVE_PORTS),
            "_h_ssh": F.array_contains("_h_set", 22),
        }
    )


def _plus(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(0.0)


def _capped(cap: float, *terms: Column) -> Column:
    total = reduce(lambda a, b: a + b, terms)
    return F.bround(F.least(F.greatest(F.least(F.lit(cap), total), F.lit(0.0)), F.lit(0.99)), 4)


def _share(value: Column, divisor: float, cap: float) -> Column:
    return F.least(value / divisor, F.lit(cap))


def rule_confidences() -> dict[str, Column]:
    """Confidence of each attack rule; null where the rule does not fire."""
    h = lambda name: F.col(f"_h_{name}")
    tcp = h("protocol") == "tcp"
    sensitive = tcp & h("sensitive") & h("is_blocked")
    brute = sensitive & ((h("pa") >= 4) | ((h("syn") >= 4) & (h("packets") >= 6)))
    return {
        "port_scan": F.when(
            tcp
            & (h("port_count") >= 50)
            & (h("syn_ratio") >= 0.65)
            & (h("connections") >= F.greatest(F.lit(20.0), h("port_count") * 0.70))
            & (h("packet_size") <= 90),
            _capped(
                0.98, F.lit(0.86), _share(h("port_count"), 2000.0, 0.07),
                _share(h("connections"), 2000.0, 0.04), _plus(h("destinations") <= 3, 0.02),
            ),
        ),
        "syn_flood": F.when(
            tcp
            & (h("syn") >= 4)
            & (h("syn_ratio") >= 0.75)
            & (h("packet_size") <= 60)
            & (h("port_count") <= 3)
            & (h("destinations") <= 3)
            & h("is_blocked"),
            _capped(
                0.97, F.lit(0.84), _share(h("syn"), 40.0, 0.08),
                _plus(h("blocked") >= 4, 0.03), _plus(h("port_count") == 1, 0.02),
            ),
        ),
        "ddos": F.when(
            (h("packets") >= 5000)
            | (h("bytes") >= 500000)
            | ((h("connections") >= 400) & (h("ppc") >= 8))
            | ((h("connections") >= 600) & (h("bpc") >= 400)),
            _capped(
                0.96, F.lit(0.72), _plus(h("packets") >= 5000, 0.08), _plus(h("bytes") >= 500000, 0.08),
                _plus(h("ppc") >= 8, 0.05), _plus(h("connections") >= 600, 0.03),
            ),
        ),
        "brute_force": F.when(
            brute,
            _capped(
                0.93, F.lit(0.78), _plus(h("ssh"), 0.08), _share(h("pa"), 20.0, 0.05),
                _plus(h("packets") >= 8, 0.02),
            ),
        ),
        "ssh_suspicious": F.when(
            ~brute & sensitive & ((h("pa") >= 1) | (h("syn") >= 2) | (h("packets") >= 2)),
            _capped(
                0.86, F.lit(0.72), _plus(h("ssh"), 0.06), F.least(h("pa_ratio"), F.lit(0.04)),
                _plus(h("blocked") >= 2, 0.02),
            ),
        ),
    }


def analyze_behaviour(windows: DataFrame) -> DataFrame:
    """Attack family, confidence and reason of every window.

    Adds ``heuristic_detected_attack``, ``heuristic_attack_type``,
    ``heuristic_confidence`` and ``heuristic_reason``.
    """
    columns = windows.columns
    df = _signals(windows)
    h = lambda name: F.col(f"_h_{name}")
    rules = rule_confidences()
    df = df.withColumns({f"_c_{name}": c for name, c in rules.items()})
    df = df.withColumn("_best", F.greatest(*[F.col(f"_c_{name}") for name in rules]))
    odd = h("is_blocked") & ~h("safe_only") & ((h("syn") >= 3) | (h("pa") >= 3) | (h("port_count") >= 20))
    small_syn = (
        (h("protocol") == "tcp")
        & (h("syn") >= 8)
        & (h("port_count") <= 3)
        & (h("destinations") <= 3)
        & (h("packet_size") <= 60)
    )
    safe = (
        (h("action") == "pass")
        & (h("blocked") == 0)
        & (h("passed") >= 1)
        & (h("port_count") <= 10)
        & h("safe_only")
        & ~small_syn
    )
    outcome = F.lit(None).cast("string")
    for name in reversed(list(rules)):
        outcome = F.when(F.col(f"_c_{name}") == F.col("_best"), name).otherwise(outcome)
    outcome = F.when(F.col("_best").isNotNull(), outcome).when(odd, "unknown_anomaly").when(
        safe, "safe_services"
    ).otherwise("no_rule")
    odd_confidence = _capped(
        0.80, F.lit(0.60), _share(h("port_count"), 200.0, 0.08), _share(h("syn"), 40.0, 0.06),
        _share(h("pa"), 20.0, 0.06),
    )
    df = df.withColumn("_outcome", outcome)
    benign = F.col("_outcome").isin("safe_services", "no_rule")
    reasons = F.create_map(*[F.lit(x) for pair in V.RULE_REASONS.items() for x in pair])
    return df.select(
        *columns,
        (~benign).alias("heuristic_detected_attack"),
        F.when(benign, "normal").otherwise(F.col("_outcome")).alias("heuristic_attack_type"),
        F.when(F.col("_best").isNotNull(), F.col("_best"))
        .when(F.col("_outcome") == "unknown_anomaly", odd_confidence)
        .when(F.col("_outcome") == "safe_services", 0.92)
        .otherwise(0.78)
        .alias("heuristic_confidence"),
        F.element_at(reasons, F.col("_outcome")).alias("heuristic_reason"),
    )


def window_instant(df: DataFrame) -> Column:
    """start of a window from the first readable source of it."""
    direct = [
        F.col(n).cast("string").try_cast("timestamp")
        for n in ("window_start", "timestamp", "time_window", "window_timestamp")
        if n in df.columns
    ]
    if "window_id" in df.columns:
        instants = F.transform(F.split(F.col("window_id"), r"\|"), lambda t: F.when(t.rlike("^[0-9]{4}-"), t).try_cast("timestamp"))
        direct.append(F.get(F.array_compact(instants), F.lit(0)))
    return F.coalesce(*direct, F.lit(None).cast("timestamp"))


def _ssh_roles(df: DataFrame) -> tuple[Column, Column]:
    """(strong anchor, weak continuation) of the SSH correlation."""
    number = lambda n: _value(df, n)
    ports = port_list(F.col("common_destination_ports")) if "common_destination_ports" in df.columns else F.array().cast("array<int>")
    extra = [_count(df, n).cast("int") for n in ("destination_port", "dst_port", "destination_port_min", "destination_port_max")]
    ports = F.array_union(ports, F.filter(F.array(*extra), lambda p: p > 0))
    count = F.greatest(
        _count(df, "destination_port_count"), F.bround(number("ports")).cast("long"), F.size(ports).cast("long")
    )
    destinations = _count(df, "destination_ip_count") if "destination_ip_count" in df.columns else F.lit(1)
    blocked = _count(df, "blocked_count")
    ssh = (
        (_text(df, "protocol") == "tcp")
        & F.array_contains(ports, 22)
        & ((_text(df, "action") == "block") | (blocked >= 1))
        & (count <= 1)
        & (destinations <= 3)
    )
    anchor = (
        (F.col("heuristic_attack_type") == "brute_force")
        & ssh
        & (blocked >= MIN_ANCHOR_BLOCKED)
        & (
            (_count(df, "tcp_pa_count") >= 4)
            | (_count(df, "tcp_syn_count") >= 4)
            | (number("packets") >= 6)
            | (number("connections") >= 6)
        )
    )
    weak = (
        (F.col("heuristic_attack_type") == "ssh_suspicious")
        & ssh
        & (blocked >= MIN_WEAK_BLOCKED)
        & (number("packets") >= 2)
        & (number("connections") >= 2)
    )
    return anchor, weak


def _row_hash(df: DataFrame) -> Column:
    """Repeatable number that spreads rows without a flow to look at."""
    if "window_id" in df.columns:
        return F.xxhash64("window_id")
    flat = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*flat)


def refine_with_context(windows: DataFrame, index_col: str | None = None) -> DataFrame:
    """Weak SSH windows next to a strong one become brute force.

    A strong window is copied into the neighbouring 120-second slots, so each
    (flow, slot) can be looked at alone: the partition of a busy flow holds six
    minutes of windows at most, however long the flow lives. All other windows get
    a slot of their own and no neighbours. With ``index_col`` a window without a
    time falls back to its row distance, at most one, within the flow.
    """
    columns = windows.columns
    anchor, weak = _ssh_roles(windows)
    source = _text(windows, "source_ip", "src_ip")
    destination = _text(windows, "destination_ip_sample", "destination_ip", "dst_ip")
    usable = (source != "") & (destination != "")
    spread = _row_hash(windows)
    df = windows.withColumns(
        {
            "_time": window_instant(windows),
            "_anchor": anchor & usable,
            "_weak": weak & usable,
            "_flow": F.array(source, destination, _text(windows, "protocol"), _text(windows, "action")),
        }
    )
    micros = F.unix_micros("_time")
    slot = F.floor(micros / (CORRELATION_SECONDS * 1_000_000)).cast("long")
    relevant = F.col("_anchor") | F.col("_weak")
    copies = F.when(F.col("_anchor"), F.array(F.lit(0), F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = df.select("*", F.explode(copies).alias("_shift")).withColumns(
        {
            "_own": F.col("_shift") == 0,
            "_micros": micros,
            "_part": F.when(relevant, F.xxhash64("_flow")).otherwise(spread),
            "_key": F.when(relevant, F.col("_flow")),
            "_slot": F.when(relevant, slot + F.col("_shift")),
        }
    )
    reach = CORRELATION_SECONDS * 1_000_000
    frame = Window.partitionBy("_part", "_key", "_slot").orderBy("_micros")
    anchored = F.when(F.col("_anchor"), 1)
    before = F.max(anchored).over(frame.rangeBetween(-reach, -1))
    after = F.max(anchored).over(frame.rangeBetween(1, reach))
    near = F.col("_weak") & (F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0)) > 0)
    df = df.withColumn("_near", near & F.col("_micros").isNotNull()).where("_own")
    if index_col:
        df = _near_by_index(df, index_col)
    confidence = F.bround(F.least(F.lit(0.91), F.greatest(F.col("heuristic_confidence") + 0.05, F.lit(0.90))), 4)
    promoted = {
        "heuristic_detected_attack": F.lit(True),
        "heuristic_attack_type": F.lit("brute_force"),
        "heuristic_confidence": confidence,
        "heuristic_reason": F.concat(F.lit(V.CONTEXT_REASON_PREFIX), F.trim("heuristic_reason")),
    }
    return df.select(
        *[F.when(F.col("_near"), promoted[n]).otherwise(F.col(n)).alias(n) if n in promoted else F.col(n) for n in columns]
    )


def _near_by_index(df: DataFrame, index_col: str) -> DataFrame:
    """Row distance at most one, where the window or the strong window has no time."""
    here = F.col(index_col)
    spread = df.select(
        "*",
        F.explode(
            F.when(F.col("_anchor"), F.array(F.lit(0), F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
        ).alias("_move"),
    ).withColumns(
        {
            "_place": here + F.col("_move"),
            "_part2": F.col("_part"),
        }
    )
    at = Window.partitionBy("_part2", "_key", "_place")
    timeless = F.max(F.when(F.col("_anchor") & F.col("_time").isNull(), 1)).over(at)
    any_anchor = F.max(F.when(F.col("_anchor"), 1)).over(at)
    adjacent = F.col("_weak") & (
        timeless.isNotNull() | (F.col("_time").isNull() & any_anchor.isNotNull())
    )
    return spread.withColumn("_near", F.col("_near") | adjacent).where(F.col("_move") == 0)
