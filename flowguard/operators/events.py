"""Eligibility filter and normalisation of parsed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard import vocabulary as V
from flowguard.functions.scalar import finite, number, text_or_null

PREPARED_COLUMNS = [
    "timestamp", "source_ip", "protocol", "action", "interface", "destination_ip",
    "destination_port", "tcp_flags", "bytes", "packets",
]


def eligible(df: DataFrame) -> DataFrame:
    """completely parsed firewall events, judged by the columns present."""
    if "parse_status" in df.columns:
        df = df.where(F.col("parse_status") == "full")
    elif "parsed_successfully" in df.columns:
        df = df.where(F.col("parsed_successfully").cast("boolean"))
    if "log_type" in df.columns:
        df = df.where(F.col("log_type") == "firewall")
    return df


def normalise_events(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ten clean columns; rows without an instant are dropped."""

    def column(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def text(name: str) -> Column:
        return F.coalesce(text_or_null(column(name).cast("string")), F.lit(V.EVENT_DEFAULTS[name]))

    def amount(name: str, default: float) -> Column:
        is_text = name not in df.columns or isinstance(df.schema[name].dataType, T.StringType)
        value = F.coalesce(finite(number(column(name), is_text)), F.lit(default))
        return F.greatest(value, F.lit(0.0))

    port = column("destination_port").try_cast("double").try_cast("int")
    instant = F.col("timestamp")
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        instant = instant.try_cast("timestamp")
    return df.select(
        instant.cast("timestamp").alias("timestamp"),
        text("source_ip").alias("source_ip"),
        F.lower(text("protocol")).alias("protocol"),
        F.lower(text("action")).alias("action"),
        text("interface").alias("interface"),
        text("destination_ip").alias("destination_ip"),
        F.when(port.between(0, 65535), port).alias("destination_port"),
        F.coalesce(F.upper(text_or_null(column("tcp_flags").cast("string"))), F.lit("")).alias("tcp_flags"),
        amount("bytes", 0.0).alias("bytes"),
        amount("packets", 1.0).alias("packets"),
        *keep,
    ).where(F.col("timestamp").isNotNull())


def prepare_events(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """F01 then F02."""
    return normalise_events(eligible(df), keep)
