"""The forest's two ways of growing and of scoring, and tuning over the default grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard import vocabulary as V
from flowguard.operators import forest as X
from flowguard.plans.train import pick_strategy, tune_forest

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 3))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(3000, None, float("nan"), 0.5), (3001, float("inf"), 1.0, 1.0), (3002, 1.0, 1.0, 1.0), (3003, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5).cache()


def grown(points, config, **bounds):
    clean = points.withColumns({n: F.nanvl(n, F.lit(0.0)) for n in NAMES}).where("abs(a) < 1e9 OR a IS NULL")
    nodes, sizes = X.grow_forests(clean, NAMES, [config], ["id"])
    return X.stored_forests(nodes, NAMES, [config], sizes)[0]


def table(forest):
    return sorted(map(tuple, forest.nodes.collect()))


def test_levels_in_spark_grow_the_same_trees(points, monkeypatch):
    config = X.ForestConfig(n_estimators=5, max_samples=0.7)
    one = grown(points, config)
    monkeypatch.setattr(X, "GROUP_ROWS", 150)
    two = grown(points.repartition(3), config)
    assert table(one) == table(two) and max(r[1] for r in table(one)) > 2**9


def test_packs_and_layers_give_the_same_scores(points, monkeypatch):
    forest = grown(points, X.ForestConfig(n_estimators=6, max_samples=0.6))
    whole = {r.id: list(r.s) for r in X.anomaly_scores(points, forest, [2, 6], "s").collect()}
    for name, value in {"BROADCAST_NODES": 10, "PACK_NODES": 4000, "SALT_ROWS": 700, "LAYER": 3}.items():
        monkeypatch.setattr(X, name, value)
    dealt = {r.id: list(r.s) for r in X.anomaly_scores(points, forest, [2, 6], "s").collect()}
    assert whole.keys() == dealt.keys() and all(np.allclose(whole[i], dealt[i]) for i in whole)


def test_trees_are_isolation_trees(points):
    forest = grown(points, X.ForestConfig(n_estimators=4, max_samples=64))
    x = {r.id: np.nan_to_num([r.a or 0.0, r.b, r.c], nan=0, posinf=0) for r in points.collect()}
    nodes = {(t, n): (f, c, p) for t, n, f, c, p in table(forest)}
    for r in X.anomaly_score(points, forest, "s").collect():
        paths = []
        for tree in range(4):
            at = 0
            while nodes[tree, at][0] >= 0:
                feature, cut, _ = nodes[tree, at]
                at = 2 * at + 1 + (x[r.id][feature] > cut)
            paths.append(nodes[tree, at][2])
        assert r.s == pytest.approx(-(2.0 ** (-np.mean(paths) / X.average_path(64))))
    assert all(n < 2**7 - 1 for _, n in nodes)


def test_a_share_draws_every_tree_at_its_rate(spark):
    df = spark.range(4000).select("id", F.rand(3).alias("a"))
    nodes, sizes = X.grow_forests(df, ["a"], [X.ForestConfig(n_estimators=8, max_samples=0.7)], ["id"])
    leaves = nodes.where("feature < 0").groupBy("tree_id").count().collect()
    assert sizes == [2800] and len(leaves) == 8


def test_splits_depend_on_tree_and_node_alone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    one, two = (X.grow_node(p, 0, 3, 0, 9, 42) for p in (x, x[rng.permutation(300)]))
    assert all((a == b).all() for a, b in zip(one, two))
    other = X.grow_node(x, 0, 4, 0, 9, 42)
    assert one[2][0] != other[2][0]
    same = X.grow_node(np.ones((9, 2)), 0, 0, 0, 9, 42)
    assert same[0].tolist() == [0] and same[1].tolist() == [-1] and same[3][0] == pytest.approx(X.average_path(9))


def test_the_default_grid_tunes_many_rows(spark):
    rows = spark.range(200_000).select(
        "id", (F.col("id") % 21 == 0).cast("int").alias("y"),
        *[(F.randn(i) + F.when(F.col("id") % 21 == 0, 4.0).otherwise(0.0) * (i % 3)).alias(n) for i, n in enumerate(V.FEATURES)],
    ).cache()
    train, validation = rows.where("id % 10 < 7"), rows.where("id % 10 >= 7")
    forest, metrics = tune_forest(train, validation, "y", ["id"])
    found = {r.candidate: r for r in metrics.collect()}
    assert sorted(found) == list(range(24)) and {r.tp + r.fn for r in found.values()} == {validation.where("y = 1").count()}
    assert max(r.recall for r in found.values()) > 0.8 and forest.stats is not None


def test_the_best_strategy_wins_by_recall_then_the_rest():
    from flowguard.plans.train import Tuned

    made = lambda name, *v: Tuned(name, None, 80.0, dict(zip(("recall", "f1_score", "false_positive_rate", "precision"), v)))
    a, b, c = made("a", 0.9, 0.5, 0.2, 0.5), made("b", 0.9, 0.5, 0.1, 0.4), made("c", 0.8, 0.9, 0.0, 1.0)
    assert pick_strategy([a, b, c]).strategy == "b" and pick_strategy([a, a, c]) is a
    with pytest.raises(ValueError):
        pick_strategy([])
