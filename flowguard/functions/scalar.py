"""Numeric, text and address expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard import vocabulary as V

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def clamp(value: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(lower)), F.lit(upper))


def strip(value: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(value, F.lit(V.WHITESPACE))


def strip_if(value: Column, unusual: Column) -> Column:
    """``strip``, at the price of a plain trim where only blanks can occur."""
    return F.when(unusual, strip(value)).otherwise(F.trim(value))


def text_or_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def number(value: Column, from_text: bool = False) -> Column:
    """Double or null; text must look like a plain decimal number."""
    if from_text:
        return F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))
    return value.cast("double")


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def sanitized(df: DataFrame, name: str) -> Column:
    """to number, non-finite to null, null to zero."""
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    return F.coalesce(finite(number(F.col(f"`{name}`"), is_text)), F.lit(0.0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """zero when the denominator is zero or null, or the result is not finite."""
    return F.coalesce(finite(F.try_divide(numerator, denominator)), F.lit(0.0))


def log1p_positive(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def integer(value: Column) -> Column:
    """Integer or null."""
    return value.try_cast("int")


def port(value: Column) -> Column:
    """Integer in 0..65535 or null."""
    parsed = integer(value)
    return F.when(parsed.between(0, 65535), parsed)


def csv_fields(payload: Column) -> Column:
    """Split one CSV record; quotes matter only where a field starts with one."""
    tokens = F.regexp_extract_all(
        F.concat(F.lit(","), payload),
        F.lit(r',("[^"]*+(?:""[^"]*+)*+(?:"[^,]*|$)|[^,]*)'),
        1,
    )
    closed = r'^"([^"]*+(?:""[^"]*+)*+)(?:"(.*))?$'

    def unquote(token: Column) -> Column:
        return F.when(
            token.startswith('"'),
            F.concat(
                F.replace(F.regexp_extract(token, closed, 1), F.lit('""'), F.lit('"')),
                F.regexp_extract(token, closed, 2),
            ),
        ).otherwise(token)

    return F.when(payload.contains('"'), F.transform(tokens, unquote)).otherwise(
        F.split(payload, ",", -1)
    )


def csv_cells(payload: Column, unusual: Column) -> Column:
    """Trimmed fields; text without quotes or blanks at commas is only split."""
    messy = payload.contains('"') | payload.contains(" ,") | payload.contains(", ") | unusual
    return F.when(messy, F.transform(csv_fields(payload), lambda x: strip(x))).otherwise(F.split(payload, ",", -1))


def cell(cells: Column, index: int | Column) -> Column:
    """Cell at ``index``; null when absent or empty."""
    return F.nullif(F.get(cells, index if isinstance(index, Column) else F.lit(index)), F.lit(""))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pin(value: Column) -> Column:
    """``value``, kept where it is computed.

    A filter on a derived column is otherwise rewritten in terms of its inputs and
    pushed below the projection, so the whole derivation would run twice.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def with_pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a derived column that filters do not look through.

    The value comes out of a one-row generator, so a filter on it stays above and the
    derivation runs once, while filters on other columns still reach the scan.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def _hex_tail(text: Column) -> Column:
    """IPv6 text whose dotted tail, if valid, became two hexadecimal groups."""
    pattern = r"^(.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    octet = [F.regexp_extract(text, pattern, i).try_cast("int") for i in range(2, 6)]
    valid = reduce(lambda a, b: a & b, [o <= 255 for o in octet]) & ~text.rlike(r"[:.]0\d+(\.|$)")
    return F.when(
        text.rlike(pattern) & valid,
        F.concat(
            F.regexp_extract(text, pattern, 1),
            F.lower(F.hex(octet[0] * 256 + octet[1])),
            F.lit(":"),
            F.lower(F.hex(octet[2] * 256 + octet[3])),
        ),
    ).otherwise(text)


def _groups(part: Column) -> Column:
    return F.when(F.coalesce(part, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(part, ":", -1)
    )


def _squeeze(groups: Column) -> Column:
    """Join eight groups, the first longest run of zero groups written as ``::``."""
    joined = F.concat(
        F.lit(":"),
        F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"),
        F.lit(":"),
    )
    shortest = bind(
        joined,
        lambda text: F.coalesce(
            *[
                F.when(
                    text.contains(":" + "0:" * run),
                    F.regexp_replace(text, "^(.*?):(?:0:){%d}" % run, "$1::"),
                )
                for run in range(8, 1, -1)
            ],
            text,
        ),
    )
    return F.regexp_replace(F.regexp_replace(shortest, "^:(?!:)", ""), "(?<!:):$", "")


def _compressed(halves: Column) -> Column:
    """Canonical text of the parts around ``::``; null when they are no IPv6 address."""

    def build(pair: Column) -> Column:
        head, tail = pair["head"], pair["tail"]
        given = F.size(head) + F.size(tail)
        valid = F.when(F.size(halves) == 1, given == 8).otherwise((F.size(halves) == 2) & (given <= 7))
        hextets = F.forall(F.concat(head, tail), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0)))
        return F.when(valid & hextets, _squeeze(F.concat(head, zeros, tail)))

    pair = F.struct(
        _groups(F.get(halves, F.lit(0))).alias("head"), _groups(F.get(halves, F.lit(1))).alias("tail")
    )
    return bind(pair, build)


def canonical_ip(value: Column) -> Column:
    """Compressed lower-case IPv6 text; anything else unchanged.

    Built from string and array expressions so that no row leaves the JVM; the
    work sits behind ``contains(':')`` and is skipped for IPv4 text.
    """

    def rewrite(text: Column) -> Column:
        bare = F.lower(F.regexp_replace(text, r"%[^%]+$", ""))
        scope = F.regexp_extract(text, r"(%[^%]+)$", 1)
        address = bind(F.split(bind(bare, _hex_tail), "::", -1), _compressed)
        return F.coalesce(F.concat(address, scope), text)

    return F.when(value.contains(":"), bind(value, rewrite)).otherwise(value)


def parse_flag(text: Column) -> Column:
    """Truthiness of a stored flag: boolean text, 1, true, yes, sim."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes", "sim"), F.lit(False))


def bool_filter(value) -> bool | None:
    """Meaning of a boolean filter given as text; empty means no filter."""
    if value is None or value == "":
        return None
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    # Accepted words.
    if word in ("1", "true", "yes", "sim", "on"):
        return True
    if word in ("0", "false", "no", "nao", "não", "off"):
        return False
    return True
