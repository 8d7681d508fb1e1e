"""Tumbling windows per source address.

Shape of the plan. Every event becomes six (attribute, value) rows; the first
aggregation counts values per window and is keyed by the value as well, so a
source or window that holds most of the data is spread over all tasks and is
combined before it is shuffled. The second aggregation folds values into one row
per window with bounded state: sums, ``min_by`` for modes, the at most 65,536
ports and the flags.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.functions.features import derived_features
from flowguard.functions.scalar import pin

ATTRIBUTES = ["protocol", "action", "interface", "destination_ip", "destination_port", "tcp_flags"]
_PROTOCOL, _ACTION, _INTERFACE, _DESTINATION, _PORT, _FLAG = range(6)
TOP_PORTS, TOP_FLAGS = 10, 5
WINDOW_COLUMNS = V.WINDOW_METADATA + V.FEATURES
_UNIT_SECONDS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}


def window_seconds(window: str | int | float | None = None) -> int:
    """Whole positive seconds of ``5``, ``"5s"``, ``"1min"`` or ``"30 days"``."""
    if window is None:
        return 5
    if isinstance(window, str):
        match = re.fullmatch(r"\s*([0-9.]+)\s*([a-z]+?)s?\s*", window.strip().lower() + " ")
        if match is None or match.group(2) not in _UNIT_SECONDS:
            raise ValueError(f"unreadable window {window!r}")
        window = float(match.group(1)) * _UNIT_SECONDS[match.group(2)]
    seconds = round(float(window))
    if window <= 0 or abs(float(window) - seconds) > 1e-9:
        raise ValueError("a window is a positive whole number of seconds")
    return seconds


def _ipv4_rank(address: Column) -> Column:
    """Position of an IPv4 text among all IPv4 texts in text order.

    A dot sorts before every digit, so text order is the order of the four octets
    compared as texts.
    """
    by_text = sorted(range(256), key=str)
    rank = F.array(*[F.lit(by_text.index(octet)) for octet in range(256)])
    octets = F.split(address, r"\.")
    total = F.lit(0).cast("long")
    for i in range(4):
        total = total * 256 + F.get(rank, F.get(octets, F.lit(i)).try_cast("int"))
    default = V.EVENT_DEFAULTS["destination_ip"]
    return F.when(address == default, F.lit(1 << 32)).when(
        address.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$") & total.isNotNull(), total
    ).otherwise(
        F.raise_error(F.concat(F.lit("not an IPv4 address, use addresses='any': "), address)).cast("long")
    )


def order_key(start: Column, seconds: int, sequence: Column, addresses: str) -> Column:
    """First-seen order (timestamp, destination, input order) inside a window.

    ``any`` is a struct and right for every text. ``ipv4`` packs the same order into
    one decimal, which lets the counting run as a hash aggregation instead of a
    sorting one; it stops the job on any other address.
    """
    if addresses == "any":
        return F.struct("timestamp", "destination_ip", sequence.alias("sequence"))
    if addresses != "ipv4":
        raise ValueError("addresses is 'any' or 'ipv4'")
    if seconds > 115 * 86400:
        raise ValueError("windows beyond 115 days need addresses='any'")
    offset = (F.unix_micros("timestamp") - F.unix_micros(start)).cast("decimal(13,0)")
    address = _ipv4_rank(F.col("destination_ip")).cast("decimal(10,0)")
    shift = lambda zeros: F.lit("1" + "0" * zeros).cast(f"decimal({zeros + 1},0)")
    return (offset * shift(25) + address * shift(15) + sequence.cast("decimal(15,0)")).cast("decimal(38,0)")


def _known_flags(flags: Column) -> Column:
    """The flag text; stops the job on one the parser cannot produce."""
    message = F.concat(F.lit("unknown flag text, use free_flags=True: "), flags)
    return F.when(flags.isin("", *V.TCP_FLAGS) | flags.isNull(), flags).otherwise(F.raise_error(message).cast("string"))


def value_counts(
    events: DataFrame, key: str, start: Column, seconds: int, sequence: Column, addresses: str, free_flags: bool = False
) -> DataFrame:
    """Occurrences and first appearance of every attribute value in every window.

    A missing action, protocol, interface or destination counts as its default, so every
    event has an action and none leaves the totals.
    """
    missing = [n for n in V.EVENT_DEFAULTS if n in ATTRIBUTES]
    events = events.withColumns({n: F.coalesce(F.nullif(F.col(n).cast("string"), F.lit("")), F.lit(V.EVENT_DEFAULTS[n])) for n in missing})
    texts = {n: F.col(n).cast("string") for n in ATTRIBUTES}
    if not free_flags:
        texts["tcp_flags"] = _known_flags(texts["tcp_flags"])
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("attribute"), F.nullif(text, F.lit("")).alias("value"))
            for i, text in enumerate(texts.values())
        ]
    )
    once = F.col("attribute") == _ACTION
    return (
        events.withColumn("_order", order_key(start, seconds, sequence, addresses))
        .select(key, "source_ip", "_order", "bytes", "packets", F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy(key, "source_ip", "attribute", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_order").alias("first"),
            F.sum(F.when(once, F.col("bytes"))).alias("bytes"),
            F.sum(F.when(once, F.col("packets"))).alias("packets"),
        )
    )


def _of(attribute: int, value: Column) -> Column:
    return F.when(F.col("attribute") == attribute, value)


def _mode(attribute: int) -> Column:
    rank = F.struct(-F.col("n"), F.col("first"))
    return F.min_by(_of(attribute, F.col("value")), _of(attribute, rank))


def _top(attribute: int, limit: int, write) -> Column:
    ranked = F.sort_array(
        F.collect_list(_of(attribute, F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("value"))))
    )
    return F.array_join(F.transform(F.slice(ranked, 1, limit), write), ",")


def _flag_text(x: Column) -> Column:
    return F.concat_ws(":", x["value"], (-x["n"]).cast("string"))


def fold_values(counts: DataFrame, key: str, flags: bool = True) -> DataFrame:
    """One row per (window, source) from its value counts."""
    value, n = F.col("value"), F.col("n")
    total = lambda attribute, *wanted: F.coalesce(
        F.sum(F.when((F.col("attribute") == attribute) & value.isin(*wanted), n)), F.lit(0)
    ).cast("long")
    port = _of(_PORT, value).cast("int")
    parts = [
        F.sum(_of(_ACTION, n)).cast("long").alias("event_count"),
        F.sum("bytes").alias("bytes"),
        F.sum("packets").alias("packets"),
        _mode(_PROTOCOL).alias("protocol"),
        _mode(_ACTION).alias("action"),
        _mode(_INTERFACE).alias("interface"),
        F.count(_of(_DESTINATION, n)).alias("destination_ip_count"),
        _mode(_DESTINATION).alias("destination_ip_sample"),
        F.min(port).alias("destination_port_min"),
        F.max(port).alias("destination_port_max"),
        F.count(port).alias("destination_port_count"),
        _top(_PORT, TOP_PORTS, lambda x: x["value"]).alias("common_destination_ports"),
        total(_FLAG, "S", "SYN").alias("tcp_syn_count"),
        total(_FLAG, "PA").alias("tcp_pa_count"),
        total(_ACTION, "block").alias("blocked_count"),
        total(_ACTION, "pass").alias("passed_count"),
    ]
    if flags:
        parts.append(_top(_FLAG, TOP_FLAGS, _flag_text).alias("tcp_flags_summary"))
    return counts.groupBy(key, "source_ip").agg(*parts)


def _ranked_flags(counts: DataFrame, key: str) -> DataFrame:
    """Flag summaries when flag texts are free-form: only the leading rows are gathered."""
    # The sums are null for flags; naming them keeps this branch on the same exchange.
    order = Window.partitionBy(key, "source_ip").orderBy(F.desc("n"), "first", "bytes", "packets")
    leading = (
        counts.where(F.col("attribute") == _FLAG)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= TOP_FLAGS)
    )
    return leading.groupBy(key, "source_ip").agg(
        _top(_FLAG, TOP_FLAGS, _flag_text).alias("tcp_flags_summary")
    )


def finish_windows(folded: DataFrame, start: Column, end: Column, seconds: int, id_suffix: str = "") -> DataFrame:
    """Identifiers and the thirteen features; column order of the window table."""
    base = {
        "connections": F.col("event_count").cast("double"),
        "bytes": F.col("bytes"),
        "packets": F.col("packets"),
        "packet_size": F.when(F.col("packets") > 0, F.col("bytes") / F.col("packets")).otherwise(0.0),
        "ports": F.col("destination_port_count").cast("double"),
    }
    stamp = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss")
    named = folded.withColumns(
        {
            "window_start": start,
            "window_end": end,
            "time_window": start,
            "src_ip": F.col("source_ip"),
            "window_id": F.concat_ws("|", "source_ip", F.concat(stamp, F.lit(id_suffix)), F.lit(f"{seconds}s")),
            **base,
        }
    )
    return named.withColumns(derived_features({n: F.col(n) for n in V.BASE_FEATURES})).select(*WINDOW_COLUMNS)


def window_features(
    events: DataFrame,
    window: str | int | float | None = None,
    *,
    sequence_col: str | None = None,
    addresses: str = "any",
    free_flags: bool = True,
    id_suffix: str = "",
) -> DataFrame:
    """Window table of prepared events (21 metadata columns, 13 features).

    ``sequence_col`` is the input order that settles ties between events of one
    instant and destination. Free flag texts are ranked before they are gathered;
    without ``free_flags`` only the fourteen texts of the parser are accepted, which
    bounds what a window gathers and saves the ranking.
    """
    seconds = window_seconds(window)
    sequence = F.col(sequence_col) if sequence_col else F.lit(0).cast("long")
    keyed = events.withColumn("_start", F.window("timestamp", f"{seconds} seconds").start)
    counts = value_counts(keyed, "_start", F.col("_start"), seconds, sequence, addresses, free_flags)
    if free_flags:
        # Kept above the exchange, so that both branches below share it.
        counts = counts.withColumn("attribute", pin(F.col("attribute")))
    folded = fold_values(counts, "_start", flags=not free_flags)
    if free_flags:
        folded = folded.join(_ranked_flags(counts, "_start"), ["_start", "source_ip"], "left").withColumn(
            "tcp_flags_summary", F.coalesce("tcp_flags_summary", F.lit(""))
        )
    end = F.col("_start") + F.make_dt_interval(secs=F.lit(seconds))
    return finish_windows(folded, F.col("_start"), end, seconds, id_suffix)


def ordered_windows(windows: DataFrame) -> DataFrame:
    """Export order."""
    return windows.orderBy("window_start", "source_ip")
