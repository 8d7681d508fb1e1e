"""Pages by key: seek after a row, or by number through an index of stored ranges.

An offset makes every earlier row be read and ordered again. A seek starts from the last
row of the page before, and a stored table of ranges knows how many rows come before each
of its parts, so that page 10,000 reads the parts that hold it and no other.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowguard.operators.history import page_bounds

INDEX = "part int, rows long, before long"


def ordering(keys: list[str]) -> list[Column]:
    """Newest first: keys in descending order, nulls last."""
    return [F.col(k).desc_nulls_last() for k in keys]


def after(keys: list[str], last: tuple) -> Column:
    """Rows that come after the row with the key values ``last`` in ``ordering``.

    A null key is the last of its column, so only a later key can follow it.
    """
    later, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, last):
        if value is None:
            equal = equal & F.col(key).isNull()
            continue
        later = later | (equal & (F.col(key).isNull() | (F.col(key) < F.lit(value))))
        equal = equal & (F.col(key) == F.lit(value))
    return later


def seek_page(df: DataFrame, keys: list[str], last: tuple | None = None, limit: int = 50) -> DataFrame:
    """The page after ``last`` (the first one without it).

    ``keys`` must identify a row. The condition reaches the scan; what passes it is a
    top-k in every task.
    """
    size, _ = page_bounds(limit)
    rows = df if last is None else df.where(after(keys, last))
    return rows.orderBy(*ordering(keys)).limit(size)


def write_ranges(df: DataFrame, path: str, keys: list[str], parts: int | None = None) -> None:
    """Store ``df`` in ranges of ``keys`` and, beside it, the rows before each range.

    Written under a new name each time; ``current`` names it last, so a reader sees the old
    table or the new one, whole.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(parts, *ordering(keys)).withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions(*ordering(keys)).write.partitionBy("part").parquet(f"{place}/rows")
    counts = spark.read.schema(ranged.schema).parquet(f"{place}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    index = counts.select("part", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    index.coalesce(1).write.parquet(f"{place}/index")
    spark.createDataFrame([(place, ranged.schema.json())], "place string, schema string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/current")


def read_page(spark: SparkSession, path: str, keys: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a table stored in ranges.

    The index gives the parts that hold the page; only these are read. The offset left within
    the first of them is less than its rows, whatever the number of the page.
    """
    size, skip = page_bounds(limit, offset)
    current = spark.read.json(f"{path.rstrip('/')}/current").first()
    place, schema = current.place, T.StructType.fromJson(json.loads(current.schema))
    index = spark.read.schema(INDEX).parquet(f"{place}/index")
    held = index.where((F.col("before") < skip + size) & (F.col("before") + F.col("rows") > skip)).orderBy("part").collect()
    rows = spark.read.schema(schema).parquet(f"{place}/rows")
    if not held:
        return rows.drop("part").limit(0)
    return rows.where(F.col("part").isin([r.part for r in held])).drop("part").orderBy(*ordering(keys)).offset(skip - held[0].before).limit(size)


def total_rows(spark: SparkSession, path: str) -> int:
    """Rows of a table stored in ranges, from its index alone."""
    place = spark.read.json(f"{path.rstrip('/')}/current").first().place
    return spark.read.schema(INDEX).parquet(f"{place}/index").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
