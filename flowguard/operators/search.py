"""Search by a stored table of trigrams.

The searchable text of a row is folded once (accents and case removed). The table has a row
per distinct three letters of a text and is laid out by a hash of them, so a query reads only
the buckets of its own trigrams. Rows that have all of them are candidates, and a plain
``contains`` on the folded text decides. Queries of one or two letters scan the folded texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.functions.display import fold, folded, search_text

BUCKETS_PER_TASK = 4


def write_index(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """Store the folded texts of ``columns`` and their trigrams by ``key``, which must identify a row."""
    spark = df.sparkSession
    buckets = BUCKETS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    texts = df.select(F.col(key).alias("key"), folded(search_text(df, columns)).alias("text"))
    texts.write.parquet(f"{place}/texts")
    stored = spark.read.parquet(f"{place}/texts")
    starts = F.sequence(F.lit(1), F.char_length("text") - 2)
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr("text", i, F.lit(3))))
    rows = stored.where(F.char_length("text") >= 3).select("key", F.explode(grams).alias("gram"))
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
    # a frequent trigram is spread over tasks, each of which writes a file of its bucket
    dealt = rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{place}/grams")
    spark.createDataFrame([(place, buckets)], "place string, buckets int").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/current")


def find_keys(spark: SparkSession, path: str, query: str) -> DataFrame:
    """keys of the rows whose text contains the query; an empty query finds all."""
    current = spark.read.json(f"{path.rstrip('/')}/current").first()
    texts = spark.read.parquet(f"{current.place}/texts")
    wanted = fold(query.strip()) if query.strip() else ""
    hit = F.contains("text", F.lit(fold(query)))
    if len(wanted) < 3:
        return texts.where(hit if wanted else F.lit(True)).select("key")
    grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    numbers = spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(current.buckets)).cast("int").alias("b")).distinct()
    buckets = [r.b for r in numbers.collect()]
    schema = T.StructType([texts.schema["key"], T.StructField("gram", T.StringType()), T.StructField("bucket", T.IntegerType())])
    held = spark.read.schema(schema).parquet(f"{current.place}/grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    keys = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("key")
    return texts.join(keys, "key", "left_semi").where(hit).select("key")


def find_rows(df: DataFrame, path: str, key: str, query: str) -> DataFrame:
    """Rows of ``df`` that the index finds."""
    found = find_keys(df.sparkSession, path, query).withColumnRenamed("key", key)
    return df.join(found, key, "left_semi")
