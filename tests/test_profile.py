"""Column profiles: few and many numbers, nulls, NaN, texts and no rows."""

from pyspark.sql import functions as F

from flowguard.operators.distributions import column_profile


def test_few_numbers_are_counted_and_many_are_measured(spark):
    df = spark.range(1000).repartition(7).select(
        (F.col("id") % 20).alias("few"), (F.col("id") % 21).alias("many"), F.when(F.col("id") % 2 == 0, F.lit(1.5)).alias("halves"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise((F.col("id") % 2).cast("double")).alias("odd"),
        F.concat(F.lit("t"), F.col("id") % 30).alias("text"), F.col("id").cast("decimal(10,2)").alias("money"), (F.col("id") % 2 == 0).alias("flag"),
        F.lit(None).cast("int").alias("nothing"),
    )
    rows = {r.column: r for r in column_profile(df, ["few", "many", "halves", "odd", "text", "money", "flag", "nothing", "absent"]).collect()}
    assert set(rows) == {"few", "many", "halves", "odd", "text", "money", "flag", "nothing"}
    assert (rows["few"].kind, rows["few"].unique_values, len(rows["few"].top_counts), rows["few"].top_counts[0].n) == ("categorical_numeric", 20, 20, 50)
    assert (rows["many"].kind, rows["many"].unique_values, rows["many"].max) == ("numeric", None, 20.0)
    assert [(e.value, e.n) for e in rows["halves"].top_counts] == [("1.5", 500)]
    assert {e.value: e.n for e in rows["odd"].top_counts} == {"NaN": 334, "0.0": 333, "1.0": 333}
    assert (rows["text"].kind, rows["text"].unique_values, len(rows["text"].top_counts)) == ("categorical", 30, 20)
    assert rows["money"].kind == "numeric" and rows["money"].mean == 499.5
    assert {e.value: e.n for e in rows["flag"].top_counts} == {"true": 500, "false": 500}
    assert (rows["nothing"].kind, rows["nothing"].unique_values) == ("categorical_numeric", 0)


def test_numbers_are_not_shuffled_one_by_one(spark):
    df = spark.range(50_000).repartition(4).select(F.rand(1).alias("x"))
    counts = column_profile(df, ["x"])
    assert counts.first().kind == "numeric"
    assert column_profile(df.limit(0), ["x"]).count() == 0
