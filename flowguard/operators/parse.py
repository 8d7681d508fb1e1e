"""Raw log lines -> typed events, as projections over one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.functions.scalar import canonical_ip, cell, csv_cells, integer, port, strip_if

_SEP = "\uffff"

EVENT_COLUMNS = [
    "timestamp", "hostname", "process", "log_type", "rule", "subrule", "anchor", "tracker",
    "interface", "reason", "action", "direction", "ip_version", "protocol_id", "protocol",
    "length", "source_ip", "destination_ip", "source_port", "destination_port", "tcp_flags",
    "icmp_type", "icmp_code", "bytes", "packets", "raw_message", "parsed_successfully", "error",
    "parse_status", "line_number", "is_syslog", "is_filterlog", "csv_payload", "syslog_message",
]


def _unusual() -> Column:
    return F.col("_unusual")


def _commas(text: Column, fields: Column) -> Column:
    counted = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    return F.when(text.contains('"'), counted).otherwise(F.size(fields) - 1)


def _looks_like_payload(text: Column, fields: Column) -> Column:
    return (_commas(text, fields) >= 10) & (F.size(fields) >= 9) & (
        F.coalesce(cell(fields, 8).isin("4", "6"), F.lit(False)) | F.lower(text).contains("filterlog")
    )


def split_header(df: DataFrame, line_col: str) -> DataFrame:
    """One regular-expression pass yields the four header parts."""
    parts = F.split(
        F.regexp_replace("_line", V.HEADER_PATTERN, f"$1{_SEP}$2{_SEP}$3{_SEP}$4"), _SEP, 4
    )
    matched = F.size("_parts") == 4

    def part(i: int) -> Column:
        return F.when(matched, strip_if(F.get("_parts", F.lit(i)), _unusual()))

    df = (
        df.withColumn("_text", F.make_valid_utf8(line_col))
        .withColumn("_unusual", F.col("_text").rlike(V.UNUSUAL_SPACE_PATTERN))
        .withColumn("_line", strip_if(F.col("_text"), _unusual()))
    )
    return (
        df.withColumn("_parts", parts)
        .withColumns(
            {
                "is_syslog": matched,
                "timestamp_text": part(0),
                "hostname": part(1),
                "process": part(2),
                "syslog_message": part(3),
            }
        )
        .drop("_parts")
    )


def event_time(raw: Column, default_year: int) -> Column:
    """Instant of a header timestamp; null when it cannot be read."""
    year = F.when(raw.rlike("^[A-Z]"), F.concat(F.lit(f"{default_year} "), F.regexp_replace(raw, r"\s+", " ")))
    return F.when(raw.rlike(r"^\d"), raw.try_cast("timestamp")).otherwise(
        F.try_to_timestamp(year, F.lit("yyyy MMM d HH:mm:ss"))
    )


def _route(df: DataFrame) -> DataFrame:
    """Find the CSV payload and its fields."""
    body = F.col("_body")
    df = df.withColumn("_body", F.coalesce("syslog_message", "_line"))
    has_word = F.lower(body).contains("filterlog")
    prefixed = has_word & body.rlike(V.PREFIX_PATTERN)
    df = df.withColumn("_prefixed", prefixed).withColumn(
        "_candidate",
        F.when(F.col("_prefixed"), strip_if(F.regexp_extract(body, V.PREFIX_PATTERN, 1), _unusual())).otherwise(body),
    )
    df = df.withColumn("_fields", csv_cells(F.col("_candidate"), _unusual()))
    # A prefixed message is also judged as a whole, prefix included.
    whole = F.when(F.col("_prefixed"), csv_cells(body, _unusual())).otherwise(F.col("_fields"))
    df = df.withColumn("_whole", whole)
    df = df.withColumn("_like", _looks_like_payload(body, F.col("_whole")))
    message = F.lower("syslog_message")
    filterlog_line = F.when(
        F.col("is_syslog"),
        F.lower("process").contains("filterlog")
        | message.contains("filterlog:")
        | message.contains("filterlog[")
        | F.col("_like"),
    ).otherwise(F.col("_like"))
    df = df.withColumn("is_filterlog", filterlog_line)
    payload = F.when(
        F.col("is_filterlog") & (F.col("_prefixed") | F.col("_like")), F.nullif("_candidate", F.lit(""))
    )
    df = df.withColumns(
        {
            "csv_payload": payload,
            "log_type": F.when(F.col("_line") == "", None)
            .when(F.col("is_filterlog"), "firewall")
            .when(F.col("is_syslog"), "syslog_other")
            .otherwise("unknown"),
        }
    )
    return df.withColumn("_readable", F.col("csv_payload").isNotNull() & (F.size("_fields") >= 9))


def _fields(df: DataFrame) -> DataFrame:
    """Positional fields of both address families."""
    fields = F.col("_fields")
    readable = F.col("_readable")

    def at(index: int) -> Column:
        return F.when(readable, cell(fields, index))

    df = df.withColumns(
        {
            "rule": at(0), "subrule": at(1), "anchor": at(2), "tracker": at(3), "interface": at(4),
            "reason": at(5), "action": F.lower(at(6)), "direction": F.lower(at(7)),
            "ip_version": integer(at(8)),
        }
    )
    v4, v6 = F.col("ip_version") == 4, F.col("ip_version") == 6

    def by_family(four: Column, six: Column) -> Column:
        return F.when(v4, four).when(v6, six)

    first, second = cell(fields, 12), cell(fields, 13)
    id_first = F.coalesce(first.rlike("^[0-9]+$"), F.lit(False))
    df = df.withColumns(
        {
            "protocol_id": by_family(
                integer(cell(fields, 15)), integer(F.when(id_first, first).otherwise(second))
            ),
            "_protocol_text": by_family(cell(fields, 16), F.when(id_first, second).otherwise(first)),
            "length": integer(by_family(cell(fields, 17), cell(fields, 14))),
            "_source": by_family(cell(fields, 18), cell(fields, 15)),
            "_destination": by_family(cell(fields, 19), cell(fields, 16)),
            "_base": by_family(F.lit(20), F.lit(17)),
        }
    )
    known = F.create_map(*[F.lit(x) for pair in V.PROTOCOL_NAMES.items() for x in pair])
    protocol = F.coalesce(
        F.lower("_protocol_text"),
        F.try_element_at(known, F.col("protocol_id")),
        F.col("protocol_id").cast("string"),
    )
    df = df.withColumns(
        {
            "protocol": protocol,
            "source_ip": canonical_ip(F.col("_source")),
            "destination_ip": canonical_ip(F.col("_destination")),
        }
    )
    ported = F.col("protocol").isin("tcp", "udp")
    icmp = F.col("protocol").isin("icmp", "icmpv6")
    base = F.col("_base")
    transport = F.slice(fields, base + 1, F.greatest(F.size(fields) - base, F.lit(0)))
    listed = F.get(
        F.filter(F.transform(transport, lambda x: F.upper(x)), lambda x: x.isin(V.TCP_FLAGS)),
        F.lit(0),
    )
    joined = F.upper(F.array_join(transport, ","))
    searched = F.nullif(F.regexp_extract(joined, V.FLAG_FIELD_PATTERN, 1), F.lit(""))
    flag = F.when(F.col("csv_payload").contains('"'), listed).otherwise(searched)
    return df.withColumns(
        {
            "source_port": F.when(ported, port(cell(fields, base))),
            "destination_port": F.when(ported, port(cell(fields, base + 1))),
            "tcp_flags": F.when(F.col("protocol") == "tcp", flag),
            "icmp_type": F.when(icmp, cell(fields, base)),
            "icmp_code": F.when(icmp, cell(fields, base + 1)),
        }
    )


def _finalise(df: DataFrame) -> DataFrame:
    """Completeness status and error text."""
    known_family = F.coalesce(F.col("ip_version").isin(4, 6), F.lit(False))
    ported = F.coalesce(F.col("protocol").isin("tcp", "udp"), F.lit(False))
    gaps = F.array_compact(
        F.array(
            *[F.when(F.col(n).isNull(), n) for n in ("protocol", "source_ip", "destination_ip")],
            *[F.when(ported & F.col(n).isNull(), n) for n in ("source_port", "destination_port")],
        )
    )
    df = df.withColumn("_gaps", F.when(known_family, gaps))
    full = known_family & (F.size("_gaps") == 0)
    error = (
        F.when(F.col("_line") == "", V.PARSE_ERRORS["blank"])
        .when(F.col("log_type") == "syslog_other", V.PARSE_ERRORS["other_syslog"])
        .when(F.col("log_type") == "unknown", V.PARSE_ERRORS["unknown"])
        .when(F.col("csv_payload").isNull(), V.PARSE_ERRORS["no_payload"])
        .when(~F.col("_readable"), V.PARSE_ERRORS["short_payload"])
        .when(~known_family, V.PARSE_ERRORS["ip_version"])
        .when(
            ~full,
            F.concat(
                F.lit(V.PARSE_ERRORS["missing_prefix"]),
                F.array_join("_gaps", ", "),
                F.lit(V.PARSE_ERRORS["missing_suffix"]),
            ),
        )
    )
    return df.withColumns(
        {
            "bytes": F.when(known_family, F.coalesce("length", F.lit(0))),
            "packets": F.when(known_family, F.lit(1)),
            "parsed_successfully": full,
            "parse_status": F.when(full, "full").when(known_family, "partial").otherwise("failed"),
            "error": error,
        }
    )


def parse_filterlog(
    df: DataFrame,
    line_col: str = "value",
    *,
    default_year: int,
    line_number_col: str | None = None,
    keep: tuple[str, ...] = (),
    skip_blank: bool = True,
) -> DataFrame:
    """Typed events of every line of ``df``; 34 columns plus ``timestamp_text`` and ``keep``.

    ``timestamp`` is an instant; ``timestamp_text`` holds the header text as found.
    One narrow projection: no shuffle, no Python.
    """
    df = df.withColumns(
        {
            "raw_message": F.col(line_col),
            "line_number": F.col(line_number_col).cast("long") if line_number_col else F.lit(None).cast("long"),
        }
    )
    df = split_header(df, line_col)
    if skip_blank:
        df = df.where(F.col("_line") != "")
    df = df.withColumn("timestamp", event_time(F.col("timestamp_text"), default_year))
    df = _finalise(_fields(_route(df)))
    # One row per line out of a generator: filters on parsed columns stay above the parse and
    # those on kept columns pass below it, down to the partitions of the scan.
    parsed = F.struct(*EVENT_COLUMNS, "timestamp_text")
    return df.select(*keep, F.inline(F.array(parsed))).select(*EVENT_COLUMNS, "timestamp_text", *keep)


def parse_stats(events: DataFrame) -> DataFrame:
    """Line totals and counts per status, one row."""
    status = F.coalesce("parse_status", F.lit("failed"))
    return events.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("parsed_successfully")).alias("parsed_successfully"),
        F.count_if(~F.coalesce("parsed_successfully", F.lit(False))).alias("parse_failures"),
        *[F.count_if(status == name).alias(f"{name}_count") for name in ("full", "partial", "failed")],
    )


def status_counts(events: DataFrame) -> DataFrame:
    """P18 in long form."""
    return events.groupBy(F.coalesce("parse_status", F.lit("failed")).alias("parse_status")).agg(
        F.count(F.lit(1)).alias("n")
    )


def first_errors(events: DataFrame, order_col: str = "line_number", limit: int = 5) -> DataFrame:
    """The first error messages in line order."""
    return (
        events.where(F.col("error").isNotNull())
        .orderBy(order_col)
        .select(order_col, "parse_status", "error")
        .limit(limit)
    )


def key_value_features(df: DataFrame, record_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """P20: base features of ``key=number`` text; the last alias of a feature wins."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(record_col, F.lit(V.KEY_VALUE_PATTERN), 1).alias("k"),
        F.regexp_extract_all(record_col, F.lit(V.KEY_VALUE_PATTERN), 2).alias("v"),
    )
    df = df.withColumn("_pairs", pairs)

    def last_value(aliases: list[str]) -> Column:
        hits = F.filter("_pairs", lambda p: F.lower(p["k"]).isin(aliases))
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["v"].try_cast("double"), F.lit(0.0))

    return df.select(*keep, *[last_value(a).alias(n) for n, a in V.KEY_ALIASES.items()])

