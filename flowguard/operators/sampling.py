"""Exact splits, balancing and row caps of labelled tables.

Every draw ranks rows by a seeded hash. Ranks are built from hash buckets of bounded
size, so one class may hold nearly all rows. ``key_cols`` must identify a row.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 200_000


def class_counts(df: DataFrame, target: str) -> dict[int, int]:
    """Rows per class: a handful of values."""
    return {int(r[target]): int(r["n"]) for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}


def spread_rank(
    df: DataFrame, group: str, key_cols: list[str], seed: int, total: int, output: str = "_rank", per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rank from one within ``group`` in a seeded random order.

    The order is that of the hash alone; buckets are ranges of it, so their number spreads
    the work and changes no rank.
    """
    bits = max(0, ceil(total / per_bucket) - 1).bit_length()
    buckets = 1 << bits
    df = df.withColumn("_hash", F.xxhash64(*key_cols, F.lit(seed))).withColumn(
        "_bucket", F.shiftright("_hash", 64 - bits) if bits else F.lit(0).cast("long")
    )
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_hash", *key_cols)).cast("long")
    ranked = df.withColumn(output, inside)
    if buckets > 1:
        # One row per (group, bucket): the running count before each bucket.
        sizes = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        ranked = ranked.join(offsets, [group, "_bucket"]).withColumn(output, F.col(output) + F.col("_before")).drop("_before")
    return ranked.drop("_hash", "_bucket")


def allocate(counts: dict[int, int], size: int) -> dict[int, int]:
    """``size`` rows shared among classes in proportion, largest remainders first."""
    total = sum(counts.values())
    exact = {c: size * n / total for c, n in counts.items()}
    share = {c: floor(x) for c, x in exact.items()}
    for c in sorted(exact, key=lambda c: (share[c] - exact[c], c))[: size - sum(share.values())]:
        share[c] += 1
    return share


def split_sizes(counts: dict[int, int], test: float, validation: float) -> dict[int, tuple[int, int, int]]:
    """(train, validation, test) rows of every class."""
    for name, value in (("test_size", test), ("validation_size", validation)):
        if not 0 < value < 1:
            raise ValueError(f"{name} lies between 0 and 1")
    if test + validation >= 1:
        raise ValueError("test_size + validation_size must stay below 1")
    total = sum(counts.values())
    held = allocate(counts, ceil(round(total * (test + validation), 9)))
    tested = allocate(held, ceil(round(sum(held.values()) * test / (test + validation), 9)))
    return {c: (counts[c] - held[c], held[c] - tested[c], tested[c]) for c in counts}


def _by_class(target: str, values: dict[int, int]):
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(table, F.col(target).cast("int"))


def stratified_split(
    df: DataFrame, target: str, key_cols: list[str], *, test: float = 0.15, validation: float = 0.15, seed: int = 42
) -> DataFrame:
    """Adds ``split`` with exact class shares."""
    counts = class_counts(df, target)
    sizes = split_sizes(counts, test, validation)
    ranked = spread_rank(df, target, key_cols, seed, sum(counts.values()))
    train = _by_class(target, {c: s[0] for c, s in sizes.items()})
    until = _by_class(target, {c: s[0] + s[1] for c, s in sizes.items()})
    part = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= until, "validation").otherwise("test")
    return ranked.withColumn("split", part).drop("_rank")


def balance(df: DataFrame, target: str, key_cols: list[str], strategy: str = "none", seed: int = 42) -> DataFrame:
    """Undersample the majority or oversample the minority, else unchanged."""
    strategy = strategy.strip().lower()
    if strategy not in ("none", "undersample_normal", "oversample_attack"):
        raise ValueError("strategy is none, undersample_normal or oversample_attack")
    if strategy == "none":
        return df
    counts = class_counts(df, target)
    if set(counts) != {0, 1} or counts[0] == counts[1]:
        return df
    minority = min(counts, key=counts.get)
    majority = 1 - minority
    few = df.where(F.col(target) == minority)
    many = df.where(F.col(target) == majority)
    if strategy == "undersample_normal":
        ranked = spread_rank(many, target, key_cols, seed, counts[majority])
        return ranked.where(F.col("_rank") <= counts[minority]).drop("_rank").unionByName(few)
    draws = min(counts[majority], 2 * counts[minority])
    picks = (
        df.sparkSession.range(draws)
        .select((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(counts[minority])) + 1).alias("_rank"))
        .groupBy("_rank")
        .agg(F.count(F.lit(1)).cast("int").alias("_times"))
    )
    ranked = spread_rank(few, target, key_cols, seed, counts[minority])
    drawn = ranked.join(picks, "_rank").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return many.unionByName(drawn.drop("_rank", "_times", "_copy"))


def balance_strategies(name: str) -> list[str]:
    name = name.strip().lower()
    return ["none", "undersample_normal", "oversample_attack"] if name == "auto" else [name]


def cap_rows(df: DataFrame, target: str, key_cols: list[str], max_rows: int | None, seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows with the class shares kept."""
    counts = class_counts(df, target)
    total = sum(counts.values())
    if max_rows is None or total <= max_rows:
        return df
    sizes = {c: min(max(1, round(max_rows * n / total)), n) for c, n in counts.items()}
    kept = spread_rank(df, target, key_cols, seed, total).where(F.col("_rank") <= _by_class(target, sizes)).drop("_rank")
    if sum(sizes.values()) <= max_rows:
        return kept
    everyone = spread_rank(kept.withColumn("_all", F.lit(0)), "_all", key_cols, seed + 1, sum(sizes.values()))
    return everyone.where(F.col("_rank") <= max_rows).drop("_rank", "_all")
