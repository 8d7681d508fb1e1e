"""Isolation forest: trees grown level by level, scored against tables of nodes.

Trees split uniformly between the extremes a node holds, so scaling a column
changes neither a tree nor a score; the forest works on unscaled features.

A node has the id of its place in a full binary tree (children of ``i`` are ``2i + 1`` and
``2i + 2``), and its split is drawn from a hash of seed, tree and id. Nodes with more than
``GROUP_ROWS`` rows are split by one grouped aggregate per level; below that a task holds the
rows of a node and grows the rest. No bound on rows, trees or nodes is needed: small node
tables travel whole to the tasks that score, larger ones are dealt out in packs of trees and
layers of ``LAYER`` levels that the rows pass one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from math import ceil, log, log1p, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.operators.quantiles import exact_percentiles
from flowguard.operators.scores import ScoreStats, collect_stats, normalise_score, with_verdict
from flowguard.session import cut_lineage

GROUP_ROWS = 200_000
BROADCAST_NODES = 2_000_000
PACK_NODES = 1_000_000
SALT_ROWS = 2_000_000
LAYER = 18
NODES = "tree_id int, node_id long, feature int, threshold double, path double"
NODE_SCHEMA = "forest_id int, " + NODES
MEMBERS = ("forest_id", "tree_id", "node_id")


@dataclass(frozen=True)
class ForestConfig:
    n_estimators: int = 300
    contamination: float = 0.05
    max_samples: str | float | int = "auto"
    scaler: str = "standard"
    seed: int = 42

    def rows_per_tree(self, total: int) -> int:
        if self.max_samples == "auto":
            return min(256, total)
        if isinstance(self.max_samples, float):
            return max(1, int(self.max_samples * total))
        return min(int(self.max_samples), total)


@dataclass(frozen=True)
class Forest:
    """A fitted forest: its stored node table, the cut-off and the training scores."""

    config: ForestConfig
    features: tuple[str, ...]
    rows_per_tree: int
    nodes: DataFrame
    offset: float = 0.0
    stats: ScoreStats | None = None
    held: dict = field(default_factory=dict, compare=False, repr=False)

    def size(self) -> int:
        """Number of nodes."""
        if "size" not in self.held:
            self.held["size"] = self.nodes.count()
        return self.held["size"]


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _uniform(*parts: Column) -> Column:
    """Repeatable number in 0..1 per row."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * (2.0**-53)


def tree_samples(
    df: DataFrame, features: list[str], forest_id: int, trees: int, rows: int, total: int, seed: int, key: Column, exact: bool = True
) -> DataFrame:
    """Rows of each tree, drawn without replacement by seeded hashes.

    Every tree draws every row at the same rate on its own. One hash names the first tree
    that draws a row (a geometric step); only rows with such a tree test the later ones, so
    most rows of a large table cost one hash. About ``trees * rows`` rows move. ``exact``
    draws a few more, to be cut to ``rows`` afterwards.
    """
    rate = min(1.0, rows * (1.0 + 6.0 / sqrt(rows) * exact) / total)
    step = F.floor(F.log(_uniform(key, F.lit(seed), F.lit(-1))) / log1p(-rate)) if rate < 1.0 else F.lit(0)
    first = F.when(step < trees, step.cast("int"))
    later = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: (t > first) & (_uniform(key, F.lit(seed), t) < rate)
    )
    chosen = F.when(first.isNotNull(), F.concat(F.array(first), later))
    return df.select(
        F.lit(forest_id).alias("forest_id"),
        F.explode(chosen).alias("tree_id"),
        F.array(*[F.col(n).cast("double") for n in features]).alias("x"),
        key.alias("row_key"),
    )


def hashed_uniform(seed: int, forest: np.ndarray, tree: np.ndarray, node: np.ndarray, turn: int) -> np.ndarray:
    """Repeatable numbers in 0..1 by tree and node, the same in every task."""
    value = np.full(len(node), (seed * 2 + turn) & (2**63 - 1), np.uint64)
    with np.errstate(over="ignore"):
        for part in (forest, tree, node):
            value = (value ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(27)
    return (value >> np.uint64(11)).astype(np.float64) * 2.0**-53


def average_paths(counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts, 3).astype(np.float64)
    usual = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(counts <= 1, 0.0, np.where(counts == 2, 1.0, usual))


def choose_splits(
    seed: int, forest: np.ndarray, tree: np.ndarray, node: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, threshold, path) of nodes with these counts and extremes."""
    depth = np.floor(np.log2(node + 1.0)).astype(np.int64)
    open_features = high > low
    choices = open_features.sum(axis=1)
    ends = (depth >= limit) | (count <= 1) | (choices == 0)
    pick = np.minimum((hashed_uniform(seed, forest, tree, node, 0) * choices).astype(np.int64), np.maximum(choices - 1, 0))
    feature = (np.cumsum(open_features, axis=1) > pick[:, None]).argmax(axis=1)
    at = np.arange(len(node))
    bottom, top = low[at, feature], high[at, feature]
    cut = bottom + hashed_uniform(seed, forest, tree, node, 1) * (top - bottom)
    cut = np.where(cut >= top, bottom, cut)
    return np.where(ends, -1, feature), np.where(ends, 0.0, cut), np.where(ends, depth + average_paths(count), 0.0)


def grow_node(x: np.ndarray, forest: int, tree: int, root: int, limit: int, seed: int) -> tuple[np.ndarray, ...]:
    """Nodes (id, feature, threshold, path) below and with ``root``, which holds the rows ``x``."""
    found: list[tuple] = []
    ids, at = np.array([root], np.int64), np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while len(rows):
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        part = x[rows]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(starts, len(rows)))
        low, high = np.minimum.reduceat(part, starts, axis=0), np.maximum.reduceat(part, starts, axis=0)
        same = np.full(len(ids), 1)
        feature, cut, path = choose_splits(seed, same * forest, same * tree, ids, count, low, high, same * limit)
        found.append((ids, feature, cut, path))
        own = np.repeat(np.arange(len(ids)), count)
        inner = feature[own] >= 0
        rows, own, part = rows[inner], own[inner], part[inner]
        right = part[np.arange(len(rows)), feature[own]] > cut[own]
        child = 2 * ids[own] + 1 + right
        ids, at = np.unique(child, return_inverse=True)
    return tuple(np.concatenate(c) for c in zip(*found))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def split_large(members: DataFrame, width: int, limits: list[int], seed: int) -> tuple[DataFrame | None, DataFrame]:
    """(nodes that were split or ended, members of the nodes below), until every node fits a task.

    A level is one aggregate over (tree, node), combined in every task before the shuffle,
    so it does not matter how many rows a node has.
    """
    depth_limit = np.array(limits)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest, tree, node, count = (batch.column(i).to_numpy() for i in range(4))
            low, high = (_matrix(batch.column(i), width) for i in (4, 5))
            feature, cut, path = choose_splits(seed, forest, tree, node, count, low, high, depth_limit[forest])
            columns = [*batch.columns[:3], pa.array(feature.astype(np.int32)), pa.array(cut), pa.array(path)]
            yield pa.RecordBatch.from_arrays(columns, [*MEMBERS, "feature", "threshold", "path"])

    done = None
    while True:
        extremes = [F.array(*[f(F.col("x")[i]) for i in range(width)]).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
        large = members.groupBy(*MEMBERS).agg(F.count("*").alias("n"), *extremes).where(F.col("n") > GROUP_ROWS)
        splits = cut_lineage(large.mapInArrow(choose, NODE_SCHEMA))
        if splits.isEmpty():
            return done, members
        done = splits if done is None else done.unionByName(splits)
        met = members.join(splits.drop("path"), list(MEMBERS), "left").where("feature IS NULL OR feature >= 0")
        below = 2 * F.col("node_id") + 1 + (F.get("x", F.col("feature")) > F.col("threshold")).cast("int")
        node = F.when(F.col("feature").isNull(), F.col("node_id")).otherwise(below)
        members = cut_lineage(met.select("forest_id", "tree_id", node.alias("node_id"), "x"))


def grow_forests(
    df: DataFrame, features: list[str], configs: list[ForestConfig], key_cols: list[str]
) -> tuple[DataFrame, list[int]]:
    """Node tables of several forests in one job.

    ``key_cols`` identify a row. A number of rows per tree is drawn exactly; a share of all
    rows is drawn at that rate. Rows with equal keys are drawn together. Nulls in a feature
    count as 0. Returns the node table and the rows per tree of each forest.
    """
    total = df.count()
    if total == 0:
        raise ValueError("a forest needs rows")
    df = df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in features})
    key = F.xxhash64(*key_cols)
    sizes = [c.rows_per_tree(total) for c in configs]
    shares = [isinstance(c.max_samples, float) for c in configs]
    seed = configs[0].seed
    limits = [ceil(log2(max(s, 2))) for s in sizes]
    parts = [
        tree_samples(df, features, i, c.n_estimators, n, total, c.seed, key, exact=not share)
        for i, (c, n, share) in enumerate(zip(configs, sizes, shares))
    ]
    counted = [p for p, share in zip(parts, shares) if not share]
    drawn = [p.drop("row_key") for p, share in zip(parts, shares) if share]
    if counted:
        order = Window.partitionBy("forest_id", "tree_id").orderBy("u", "row_key")
        most = F.get(F.array(*[F.lit(s) for s in sizes]), F.col("forest_id"))
        ranked = (
            reduce(DataFrame.unionByName, counted)
            .withColumn("u", _uniform(F.col("row_key"), F.col("tree_id"), F.lit(seed + 2)))
            .withColumn("_rank", F.row_number().over(order))
        )
        drawn.append(ranked.where(F.col("_rank") <= most).select("forest_id", "tree_id", "x"))
    members = reduce(DataFrame.unionByName, drawn).withColumn("node_id", F.lit(0).cast("long"))
    top = None
    if max(sizes) > GROUP_ROWS:
        top, members = split_large(cut_lineage(members), len(features), limits, seed)
    width = len(features)

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        forest, tree, root = (k.as_py() for k in key)
        ids, feature, cut, path = grow_node(_matrix(rows.column("x"), width), forest, tree, root, limits[forest], seed)
        n = len(ids)
        return pa.table({
            "forest_id": pa.array(np.full(n, forest), pa.int32()), "tree_id": pa.array(np.full(n, tree), pa.int32()), "node_id": ids,
            "feature": pa.array(feature, pa.int32()), "threshold": cut, "path": path,
        })

    nodes = members.groupBy(*MEMBERS).applyInArrow(grow, NODE_SCHEMA)
    return (nodes if top is None else nodes.unionByName(top)), sizes


def stored_forests(nodes: DataFrame, features: list[str], configs: list[ForestConfig], sizes: list[int]) -> list[Forest]:
    """The forests of one node table, which is stored once."""
    nodes = cut_lineage(nodes)
    return [
        Forest(c, tuple(features), s, nodes.where(F.col("forest_id") == i).drop("forest_id"))
        for i, (c, s) in enumerate(zip(configs, sizes))
    ]


class NodePack:
    """Arrays of some nodes, in order of tree and id, that rows walk down together."""

    def __init__(self, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray):
        order = np.lexsort((node, tree))
        self.tree, self.node = tree[order].astype(np.int32), node[order].astype(np.int64)
        self.feature, self.threshold, self.path = feature[order].astype(np.int16), threshold[order], path[order]
        key = (self.tree.astype(np.int64) << 40) + self.node
        child = (self.tree.astype(np.int64) << 40) + 2 * self.node + 1
        at = np.minimum(np.searchsorted(key, child), len(key) - 1)
        self.left = np.where((self.feature >= 0) & (key[at] == child), at, -1).astype(np.int32)
        self.key = key

    def walk(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Place of the node where each row ends: a leaf, or a node whose children are elsewhere."""
        at, going = start.copy(), np.arange(len(start))
        going = going[self.left[at] >= 0]
        while len(going):
            here = at[going]
            right = x[going, self.feature[here]] > self.threshold[here]
            here = self.left[here] + right
            at[going] = here
            going = going[self.left[here] >= 0]
        return at

    def places(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, (tree.astype(np.int64) << 40) + node)


def packed(forest: Forest) -> NodePack:
    """The whole node table on the driver; only for tables of at most ``BROADCAST_NODES`` nodes."""
    if "pack" not in forest.held:
        rows = forest.nodes.select("tree_id", "node_id", "feature", "threshold", "path").toPandas()
        forest.held["pack"] = NodePack(*[rows[c].to_numpy() for c in rows.columns])
    return forest.held["pack"]


def _prefix_sums(pack: NodePack, x: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of path lengths over the first ``counts`` trees, a column each."""
    sums = np.zeros((len(x), len(counts)))
    roots = np.flatnonzero(pack.node == 0)
    for root in roots:
        value = pack.path[pack.walk(x, np.full(len(x), root, np.int64))]
        for i, c in enumerate(counts):
            if pack.tree[root] < c:
                sums[:, i] += value
    return sums


def _clean(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def _sums_by_broadcast(df: DataFrame, forest: Forest, counts: list[int], target: str) -> DataFrame:
    if "broadcast" not in forest.held:
        forest.held["broadcast"] = df.sparkSession.sparkContext.broadcast(packed(forest))
    shared = forest.held["broadcast"]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sums(frame: pd.DataFrame) -> pd.Series:
        x = _clean(frame.to_numpy(dtype=float))
        parts = [_prefix_sums(shared.value, x[i : i + 4096], counts) for i in range(0, len(x), 4096)]
        return pd.Series([row for part in parts for row in part])

    return df.withColumn(target, sums(F.struct(*[F.col(n).cast("double") for n in forest.features])))


def _sums_by_packs(df: DataFrame, forest: Forest, counts: list[int], target: str) -> DataFrame:
    """Rows pass the packs of trees, layer after layer; no task holds more than a pack.

    A unit is a pack of whole trees in the first layer and one subtree in those below, each
    copied to several splits where many rows come. Its nodes arrive before its rows.
    """
    width, most = len(forest.features), max(counts)
    keyed = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in forest.features])
    depth = F.floor(F.log2(F.col("node_id") + F.lit(1.0))).cast("int")
    layer = F.floor(depth / LAYER).cast("int")
    nodes = forest.nodes.where(F.col("tree_id") < most).withColumns({"depth": depth, "layer": layer})
    per_layer = {r.layer: r for r in nodes.groupBy("layer").agg(F.count("*").alias("n"), F.count_distinct("tree_id").alias("trees")).collect()}
    splits = max(1, -(-keyed.count() // SALT_ROWS))
    part = F.pmod(F.xxhash64("_row"), F.lit(splits)).cast("int")
    rows = keyed.select("_row", x.alias("x"), F.lit(None).cast("int").alias("tree_id"), F.lit(0).cast("long").alias("node_id"))
    totals = None
    for number in sorted(per_layer):
        n, trees = per_layer[number].n, per_layer[number].trees
        if number == 0:
            each = max(1, PACK_NODES * trees // max(n, 1))
            unit, packs = F.floor(F.col("tree_id") / each).cast("long"), -(-most // each)
            arriving = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))).alias("unit"), part.alias("part"), "_row", "x", "tree_id", "node_id")
        else:
            root = F.call_function("shiftright", F.col("node_id") + 1, F.col("depth") - number * LAYER)
            unit = F.xxhash64("tree_id", root)
            arriving = rows.select(F.xxhash64("tree_id", F.col("node_id") + 1).alias("unit"), part.alias("part"), "_row", "x", "tree_id", "node_id")
        own = nodes.where(F.col("layer") == number).select(
            unit.alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part"), "tree_id", "node_id", "feature", "threshold", "path"
        )
        both = own.unionByName(arriving, allowMissingColumns=True).select("unit", "part", "_row", "tree_id", "node_id", "feature", "threshold", "path", "x")
        dealt = both.repartition("unit", "part").sortWithinPartitions("unit", "part", F.col("_row").isNotNull())
        passed = cut_lineage(dealt.mapInArrow(_walker(counts, width), "_row long, sums array<double>, x array<double>, tree_id int, node_id long"))
        found = passed.where("sums IS NOT NULL").select("_row", "sums")
        totals = found if totals is None else totals.unionByName(found)
        rows = passed.where("sums IS NULL").select("_row", "x", "tree_id", "node_id")
    summed = totals.groupBy("_row").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(counts))])
    sums = summed.select("_row", F.array(*[f"s{i}" for i in range(len(counts))]).alias(target))
    return keyed.join(sums, "_row").drop("_row")


def _walker(counts: list[int], width: int):
    schema = pa.schema([("_row", pa.int64()), ("sums", pa.list_(pa.float64())), ("x", pa.list_(pa.float64())), ("tree_id", pa.int32()), ("node_id", pa.int64())])

    def passed(pack: NodePack, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, names = _clean(_matrix(part.column(8), width)), part.column(2).to_numpy()
        first = part.column(3).null_count == part.num_rows
        n = len(names)
        if first:
            starts = [(int(pack.tree[r]), np.full(n, r, np.int64)) for r in np.flatnonzero(pack.node == 0)]
        else:
            trees = part.column(3).to_numpy()
            starts = [(None, pack.places(trees, part.column(4).to_numpy()))]
        sums, ends = np.zeros((n, len(counts))), np.zeros(n, bool)
        for tree, start in starts:
            at = pack.walk(x, start)
            leaf = pack.feature[at] < 0
            of = np.full(n, tree) if first else trees
            for i, c in enumerate(counts):
                sums[:, i] += np.where(leaf & (of < c), pack.path[at], 0.0)
            ends |= leaf
            on = np.flatnonzero(~leaf)
            if len(on):
                here = at[on]
                below = 2 * pack.node[here] + 1 + (x[on, pack.feature[here]] > pack.threshold[here])
                yield pa.RecordBatch.from_arrays([pa.array(names[on]), pa.nulls(len(on), schema.field(1).type), part.column(8).take(pa.array(on)), pa.array(of[on].astype(np.int32)), pa.array(below)], schema=schema)
        done = np.flatnonzero(ends)
        if len(done):
            nothing = [pa.nulls(len(done), schema.field(i).type) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(names[done]), pa.array(list(sums[done]), schema.field(1).type), *nothing], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, pack = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            is_row = ~np.asarray(batch.column(2).is_null())
            edges = np.flatnonzero((np.diff(unit) != 0) | (np.diff(part) != 0) | (np.diff(is_row) != 0)) + 1
            for i, j in zip([0, *edges], [*edges, batch.num_rows]):
                if (unit[i], part[i]) != current:
                    current, held, pack = (unit[i], part[i]), [], None
                if not is_row[i]:
                    held.append([batch.column(k).slice(i, j - i).to_numpy(zero_copy_only=False) for k in range(3, 8)])
                    continue
                if pack is None:
                    pack = NodePack(*[np.concatenate(c) for c in zip(*held)])
                yield from passed(pack, batch.slice(i, j - i))

    return run


def anomaly_scores(df: DataFrame, forest: Forest, counts: list[int], target: str) -> DataFrame:
    """An array of mean-path scores in -1..0 (lower is more unusual), one per number of first trees.

    Node tables of at most ``BROADCAST_NODES`` go whole to every task, checked before; larger
    ones are dealt out in packs. Both give the same scores. Nulls and non-finite values count as 0.
    """
    by = _sums_by_broadcast if forest.size() <= BROADCAST_NODES else _sums_by_packs
    norm = average_path(forest.rows_per_tree) or 1.0
    sums = by(df, forest, counts, target)
    scores = [-F.pow(F.lit(2.0), -(F.col(target)[i] / c) / norm) for i, c in enumerate(counts)]
    return sums.withColumn(target, F.array(*scores))


def anomaly_score(df: DataFrame, forest: Forest, target: str) -> DataFrame:
    """Mean-path score in -1..0, lower is more unusual."""
    return anomaly_scores(df, forest, [forest.config.n_estimators], target).withColumn(target, F.col(target)[0])


def calibrate(df: DataFrame, forest: Forest) -> Forest:
    """Cut-off at the contamination percentile of the training scores, and their statistics."""
    scored = cut_lineage(anomaly_score(df.select(*forest.features), forest, "_s").select("_s"))
    offset = exact_percentiles(scored, "_s", [100.0 * forest.config.contamination])[0]
    raw = scored.select((F.lit(offset) - F.col("_s")).alias("raw"))
    return replace(forest, offset=offset, stats=collect_stats(raw, "raw"))


def fit_forest(
    df: DataFrame, features: list[str], config: ForestConfig | None = None, *, key_cols: list[str]
) -> Forest:
    """Grow, then calibrate on all rows."""
    config = config or ForestConfig()
    nodes, sizes = grow_forests(df, features, [config], key_cols)
    return calibrate(df, stored_forests(nodes, features, [config], sizes)[0])


def score_forest(df: DataFrame, forest: Forest) -> DataFrame:
    """``score_if``, its normalised form, prediction, label and confidence."""
    df = anomaly_score(df, forest, "_s").withColumn("score_if", F.lit(forest.offset) - F.col("_s")).drop("_s")
    df = normalise_score(df, "score_if", "score_if_normalized", forest.stats)
    return with_verdict(df, "if", F.col("score_if") > 0, "score_if_normalized")


def forest_grid(
    estimators: tuple[int, ...] = (100, 200, 300),
    contaminations: tuple[float, ...] = (0.01, 0.03, 0.05, 0.1),
    samples: tuple = ("auto", 0.7),
    scalers: tuple[str, ...] = ("standard",),
    seed: int = 42,
) -> list[ForestConfig]:
    """Candidate configurations (fixed values: the defaults)."""
    return [
        ForestConfig(n, c, m, s, seed) for n in estimators for c in contaminations for m in samples for s in scalers
    ]


def tree_prefix(forest: Forest, config: ForestConfig) -> Forest:
    """The forest made of the first trees of a larger one."""
    return replace(forest, config=config, nodes=forest.nodes.where(F.col("tree_id") < config.n_estimators), held={})
