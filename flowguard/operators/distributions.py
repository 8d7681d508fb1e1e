"""Counts per value, numeric summaries and column profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.functions.scalar import finite, number


def key_text(column: Column) -> Column:
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit("unknown"))


def distributions(df: DataFrame, columns: list[str], weight: Column | None = None) -> DataFrame:
    """(dimension, value, n) of several columns in one scan."""
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    keyed = df.select(*[key_text(F.col(c)).alias(c) for c in columns], *([weight.alias("_w")] if weight is not None else []))
    n = F.sum("_w") if weight is not None else n
    grouped = keyed.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in columns], n.alias("n")
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        dimension = F.when(F.col(f"_g_{c}") == 0, c).otherwise(dimension)
        value = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), F.col("n").cast("long").alias("n"))


def distribution_maps(long: DataFrame, columns: list[str], suffix: str = "_distribution") -> DataFrame:
    """Long counts as one row with a map per dimension."""
    entry = F.struct(F.col("value"), F.col("n"))
    return long.agg(
        *[
            F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("dimension") == c, entry)))).alias(f"{c}{suffix}")
            for c in columns
        ]
    )


def pair_distribution(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of value pairs, most frequent first."""
    return df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), first, second)


def filled(column: Column) -> Column:
    return F.coalesce(finite(column.cast("double")), F.lit(0.0))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max and mean per column, null counted as zero; one row per column."""
    wide = df.agg(
        *[
            F.struct(F.min(filled(F.col(c))).alias("min"), F.max(filled(F.col(c))).alias("max"), F.avg(filled(F.col(c))).alias("mean")).alias(c)
            for c in columns
        ]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.min").alias("min"), F.col(f"{c}.max").alias("max"), F.col(f"{c}.mean").alias("mean")) for c in columns])
    return wide.select(F.inline(rows))


def quality_audit(df: DataFrame, features: list[str]) -> DataFrame:
    """Null, negative and infinite counts per feature, from one aggregate."""
    parts = {}
    for name in features:
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        value = number(F.col(name), isinstance(kind, T.StringType))
        missing = F.col(name).isNull() | (F.isnan(value) if isinstance(kind, T.DoubleType | T.FloatType) else F.lit(False))
        parts[name] = F.struct(
            F.lit(name).alias("feature"),
            F.lit(kind.simpleString()).alias("dtype"),
            F.count_if(missing).alias("nulls"),
            F.count_if(F.coalesce(value < 0, F.lit(False))).alias("negatives"),
            F.count_if(F.coalesce(F.abs(value) == float("inf"), F.lit(False))).alias("infinites"),
        )
    return df.agg(F.array(*parts.values()).alias("_rows")).select(F.inline("_rows"))


def frame_audit(df: DataFrame, features: list[str]) -> dict:
    """Facts that the schema alone answers."""
    return {
        "missing_features": [n for n in features if n not in df.columns],
        "metadata_columns": [n for n in df.columns if n not in features],
        "feature_order_matches": [n for n in df.columns if n in features] == list(features),
    }


def column_profile(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """Per column its kind and either the leading values or min, max and mean.

    Texts are grouped by value, spread over tasks. A numeric column matters by its values
    only while there are at most ``top`` of them, so a task counts them in a set of that
    size and, once there are more, sends a mark instead: at most ``top + 1`` rows per column
    and task are shuffled, however many numbers there are.
    """
    present = [c for c in columns if c in df.columns]
    textual = [c for c in present if isinstance(df.schema[c].dataType, T.StringType | T.BooleanType)]
    numeric = [c for c in present if c not in textual]
    parts = []
    if textual:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in textual])
        parts.append(df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    if numeric:
        parts.append(_few_values(df, numeric, top))
    counts = reduce(DataFrame.unionByName, parts)
    # One row per column of interest, whatever the size of the data.
    uniques = counts.groupBy("column").agg(F.count("value").alias("unique_values"), F.min("n").alias("_least"))
    leading = _leading(counts.where("n > 0"), top)
    profile = uniques.join(leading, "column", "left")
    summary = numeric_summary(df, numeric) if numeric else None
    if summary is not None:
        profile = profile.join(summary, "column", "left")
    else:
        profile = profile.withColumns({n: F.lit(None).cast("double") for n in ("min", "max", "mean")})
    few = (F.col("unique_values") <= top) & (F.col("_least") > 0)
    kind = F.when(F.col("column").isin(textual), "categorical").when(few, "categorical_numeric").otherwise("numeric")
    counted = F.col("kind") != "numeric"
    return profile.withColumn("kind", kind).select(
        "column",
        "kind",
        F.when(counted, F.col("unique_values")).alias("unique_values"),
        F.when(counted, F.col("top_counts")).alias("top_counts"),
        *[F.when(~counted, F.col(n)).alias(n) for n in ("min", "max", "mean")],
    )


def _few_values(df: DataFrame, numeric: list[str], top: int) -> DataFrame:
    """(column, value, n) of numeric columns; a column with more than ``top`` values has a row with n = -1."""
    whole = {c: isinstance(df.schema[c].dataType, T.IntegralType) for c in numeric}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict | None] = {c: {} for c in numeric}
        for batch in batches:
            for c in numeric:
                held = seen[c]
                if held is None:
                    continue
                for item in pc.value_counts(batch.column(c)).to_pylist():
                    value = item["values"]
                    key = "NaN" if value != value else value
                    held[key] = held.get(key, 0) + item["counts"]
                if len(held) - (None in held) > top:
                    seen[c] = None
        rows = []
        for c, held in seen.items():
            entries = [(None, -1)] if held is None else list(held.items())
            for key, n in entries:
                value = float("nan") if key == "NaN" else key
                rows.append((c, value if value is not None and whole[c] else None, value if value is not None and not whole[c] else None, n))
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64())
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["column", "whole", "real", "n"])

    typed = df.select(*[F.col(c).cast("long" if whole[c] else "double").alias(c) for c in numeric])
    told = typed.mapInArrow(run, "column string, whole long, real double, n long")
    value = F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"))
    summed = F.when(F.min("n") < 0, F.lit(-1).cast("long")).otherwise(F.sum("n"))
    return told.groupBy("column", value.alias("value")).agg(summed.alias("n"))


def _leading(counts: DataFrame, top: int) -> DataFrame:
    from pyspark.sql import Window

    rank = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    kept = counts.where(F.col("value").isNotNull()).withColumn("_rank", F.row_number().over(rank)).where(
        F.col("_rank") <= top
    )
    entry = F.struct("_rank", "value", "n")
    return kept.groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n"))).alias("top_counts")
    )


def chart_rows(long: DataFrame) -> DataFrame:
    """Share of the largest count (at least 4 %) and rank per dimension."""
    from pyspark.sql import Window

    every = Window.partitionBy("dimension")
    # Bars follow the values of a dimension, a handful of labels.
    width = F.greatest(F.lit(4), F.round(F.col("n") / F.greatest(F.max("n").over(every), F.lit(1)) * 100).cast("int"))
    return long.withColumns(
        {"bar_width": width, "rank": F.row_number().over(every.orderBy(F.desc("n"), "value"))}
    )
