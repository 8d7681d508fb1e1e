"""The thirteen window features and the label expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard import vocabulary as V
from flowguard.functions.scalar import log1p_positive, safe_ratio, sanitized


def derived_features(base: dict[str, Column]) -> dict[str, Column]:
    """Ratio and log expressions over the five base features."""
    ratios = {
        "bytes_per_packet": safe_ratio(base["bytes"], base["packets"]),
        "bytes_per_connection": safe_ratio(base["bytes"], base["connections"]),
        "packets_per_connection": safe_ratio(base["packets"], base["connections"]),
    }
    logs = {f"log1p_{name}": log1p_positive(base[name]) for name in V.BASE_FEATURES}
    return {**ratios, **logs}


def sanitize_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """F03 over several columns."""
    return df.withColumns({name: sanitized(df, name) for name in columns})


def with_features(df: DataFrame, extended: bool = True) -> DataFrame:
    """clean the base features and add the derived ones."""
    missing = [name for name in V.BASE_FEATURES if name not in df.columns]
    if missing:
        raise ValueError(f"missing base features: {missing}")
    df = sanitize_numeric(df, V.BASE_FEATURES)
    if not extended:
        return df
    return df.withColumns(derived_features({name: F.col(name) for name in V.BASE_FEATURES}))


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def resolve_base_features(df: DataFrame) -> DataFrame:
    """five base columns, from their own names or from the raw flow names."""
    df = strip_column_names(df)
    if set(V.BASE_FEATURES) <= set(df.columns):
        source = {name: name for name in V.BASE_FEATURES}
    elif set(V.RAW_FLOW_COLUMNS) <= set(df.columns):
        source = {target: raw for raw, target in V.RAW_FLOW_COLUMNS.items()}
    else:
        base_gap = [n for n in V.BASE_FEATURES if n not in df.columns]
        raw_gap = [n for n in V.RAW_FLOW_COLUMNS if n not in df.columns]
        raise ValueError(
            f"need the base features (missing {base_gap}) or the raw flow columns (missing {raw_gap})"
        )
    rest = [F.col(f"`{n}`") for n in df.columns if n not in source.values() and n not in source]
    return df.select(*[sanitized(df, source[n]).alias(n) for n in V.BASE_FEATURES], *rest)


def extract_label(df: DataFrame, output: str = "y") -> DataFrame:
    """replace the first known label column by an integer column."""
    df = strip_column_names(df)
    found = next((name for name in V.LABEL_COLUMNS if name in df.columns), None)
    if found is None:
        return df
    value = F.col(f"`{found}`")
    if isinstance(df.schema[found].dataType, T.NumericType | T.BooleanType):
        label = F.coalesce(value.cast("double").try_cast("int"), F.lit(0))
    else:
        label = F.when(F.upper(F.trim(value)).isin(V.BENIGN_LABELS_UPPER), 0).otherwise(1)
    return df.withColumn(output, label).drop(found) if output != found else df.withColumn(output, label)


def normalize_labels(df: DataFrame) -> DataFrame:
    """trim ``label`` and derive the binary ``target``."""
    label = F.trim(F.col("label").cast("string"))
    return df.withColumns(
        {"label": label, "target": F.when(label.isin(V.BENIGN_LABELS_EXACT), 0).otherwise(1)}
    )
