"""Frames of exactly one row, attached as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row frame.

    The row is computed once and handed to the tasks as a literal; no join is planned.
    """
    value = one.select(F.struct(*one.columns).alias("row")).scalar()
    return df.withColumn("_one", value).select(*df.columns, *[F.col(f"_one.`{c}`").alias(c) for c in one.columns])
