import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.config import DecisionConfig, EnsembleConfig, decision_profile, ensemble_profile, resolve_profile
from flowguard.operators import sampling as S
from flowguard.operators.decision import decide
from flowguard.operators.ensemble import sweep_candidates
from flowguard.operators.forest import ForestConfig, average_path, fit_forest, forest_grid, grow_forests, score_forest, tree_samples
from flowguard.operators.quantiles import column_percentiles, exact_percentiles
from flowguard.operators.reconstruction import fit_reconstruction, reconstruction_error, score_reconstruction
from flowguard.operators.scaling import fit_scaler
from flowguard.operators.scores import ScoreStats, normalise_score


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    x[:, 2] = x[:, 0] * 2 + rng.normal(size=600) * 0.05
    x[:6] = [[9, -9, 4], [8, 8, -20], [-9, 9, 30], [10, 0, -9], [0, 12, 9], [-8, -8, 15]]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5).cache()


NAMES = ["a", "b", "c"]


def test_forest_finds_outliers(points):
    forest = fit_forest(points, NAMES, ForestConfig(n_estimators=100, contamination=0.02), key_cols=["id"])
    scored = score_forest(points, forest)
    top = [r.id for r in scored.orderBy(F.desc("score_if")).limit(6).collect()]
    assert set(top) == set(range(6))
    flagged = scored.where("pred_if = 1").count()
    assert abs(flagged - 12) <= 1
    row = scored.agg(F.min("score_if_normalized"), F.max("score_if_normalized")).first()
    assert (row[0], row[1]) == (0.0, 1.0)


def test_forest_is_repeatable_and_balanced(points):
    config = ForestConfig(n_estimators=10, max_samples=64)
    first, sizes = grow_forests(points, NAMES, [config], ["id"])
    again, _ = grow_forests(points.repartition(2), NAMES, [config], ["id"])
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert sizes == [64] and key(first) == key(again)
    assert first.select("tree_id").distinct().count() == 10
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_grid_size():
    assert len(forest_grid()) == 24
    assert ForestConfig(max_samples=0.7).rows_per_tree(1000) == 700
    assert ForestConfig().rows_per_tree(100) == 100


def test_reconstruction(points):
    model = fit_reconstruction(points, NAMES, components=2, percentile=95)
    x = np.array([[r.a, r.b, r.c] for r in points.orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    want = ((z - z @ v[:2].T @ v[:2]) ** 2).mean(axis=1)
    got = [r[0] for r in points.orderBy("id").select(reconstruction_error(model)).collect()]
    assert np.allclose(got, want, atol=1e-8)
    assert model.threshold == pytest.approx(np.percentile(want, 95), rel=1e-6)
    assert score_reconstruction(points, model).where("pred_ae = 1").count() == (want > model.threshold).sum()


def test_exact_percentiles_narrow_to_the_same_value(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(size=30_000), np.full(20_000, 2.5), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    wanted = [0, 5, 37.5, 50, 60, 90, 99.9, 100]
    assert np.allclose(exact_percentiles(df, "x", wanted, gather=10), np.percentile(x, wanted), rtol=1e-12)
    assert np.allclose(exact_percentiles(df, "x", wanted), np.percentile(x, wanted), rtol=1e-12)


def test_scaler_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = fit_scaler(df, ["a", "b"]).transform(df).orderBy("a").collect()
    assert [(r.scaled_a, r.scaled_b) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_normalise_falls_back_to_sigmoid(spark):
    one = spark.createDataFrame([(3.0,)], "s double")
    stats = ScoreStats(1.0, 1.0, 1.0, 0.5)
    value = normalise_score(one, "s", "n", stats).first().n
    assert value == pytest.approx(1 / (1 + np.exp(-2.0)))
    assert normalise_score(one, "s", "n", ScoreStats(0.0, 2.0, 1.0, 0.5)).first().n == 1.0


def test_profiles():
    balanced, conservative = ensemble_profile(), ensemble_profile(profile="conservative")
    assert (balanced.threshold, balanced.if_weight, balanced.strong, balanced.alert_floor) == (0.32, 0.18, 0.68, 0.72)
    assert (conservative.threshold, conservative.conflict, conservative.high_boost) == (0.60, 0.08, 0.0)
    assert sum(EnsembleConfig(if_weight=0.5).weights()) == pytest.approx(1.0)
    d = decision_profile()
    assert (d.if_weight, d.strong, d.moderate, d.supportive, d.contextual, d.suppressive, d.safe_negative) == (
        0.14, 0.68, 0.50, 0.10, 0.04, 0.04, 0.05,
    )
    c = decision_profile(DecisionConfig(), "conservative", prioritize_precision=True)
    assert (c.strong, c.moderate, c.suppressive) == (0.76, 0.58, 0.18)
    assert resolve_profile("x") == "balanced"
    assert len(sweep_candidates()) == 4 and len(sweep_candidates(clipped=False)) == 16


def test_decision_without_optional_scores(spark):
    df = spark.createDataFrame(
        [(1, 0.2, 1, 2.0, True, "ddos", 0.95), (0, -0.2, 0, 0.01, False, "normal", 0.9)],
        "pred_if int, score_if double, pred_ae int, score_ae double, heuristic_detected_attack boolean, heuristic_attack_type string, heuristic_confidence double",
    )
    rows = decide(df, ae_reference=1.0).collect()
    assert (rows[0].decision_source, rows[0].attack_type, rows[0].final_label) == ("heuristic_signature", "ddos", "anomaly")
    assert (rows[1].decision_source, rows[1].risk_level, rows[1].confidence) == ("safe_negative", "low", 1.0)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))


def test_split_is_exact_and_repeatable(labelled):
    a = S.stratified_split(labelled, "y", ["id"])
    counts = {(r.split, r.y): r["count"] for r in a.groupBy("split", "y").count().collect()}
    assert counts == {("train", 0): 630, ("train", 1): 70, ("validation", 0): 135, ("validation", 1): 15, ("test", 0): 135, ("test", 1): 15}
    b = S.stratified_split(labelled.repartition(7), "y", ["id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        S.stratified_split(labelled, "y", ["id"], test=0.6, validation=0.5)


def test_ranks_hold_across_buckets(labelled):
    ranked = S.spread_rank(labelled, "y", ["id"], 1, 1000, per_bucket=37)
    for y, n in ((0, 900), (1, 100)):
        ranks = sorted(r["_rank"] for r in ranked.where(F.col("y") == y).collect())
        assert ranks == list(range(1, n + 1))


def test_balance(labelled, spark):
    under = S.balance(labelled, "y", ["id"], "undersample_normal")
    assert {r.y: r["count"] for r in under.groupBy("y").count().collect()} == {0: 100, 1: 100}
    over = S.balance(labelled, "y", ["id"], "oversample_attack")
    assert {r.y: r["count"] for r in over.groupBy("y").count().collect()} == {0: 900, 1: 200}
    even = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("y"))
    assert S.balance(even, "y", ["id"], "undersample_normal").count() == 10
    assert S.cap_rows(labelled, "y", ["id"], 50).groupBy("y").count().orderBy("y").collect()[1]["count"] == 5
    assert S.cap_rows(labelled, "y", ["id"], None).count() == 1000
    with pytest.raises(ValueError):
        S.balance(labelled, "y", ["id"], "other")


def test_percentiles_of_many_columns_and_odd_values(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(0, 8, 900), np.zeros(100)])
    rows = [(float(v), float(-v), 3.0, None, float("inf") if i % 2 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    wanted = [0, 5, 33.3, 50, 100]
    for gather in (0, 7, 10_000):
        got = column_percentiles(df, {n: wanted for n in "abcd"} | {"e": [10, 90]}, gather)
        assert np.allclose(got["a"], np.percentile(x, wanted), rtol=1e-12)
        assert np.allclose(got["b"], np.percentile(-x, wanted), rtol=1e-12)
        assert got["c"] == [3.0] * 5 and got["d"] == [None] * 5
        assert np.isfinite(got["e"][0]) and got["e"][1] == float("inf")
    with pytest.raises(ValueError):
        exact_percentiles(df, "d", [50])


def test_ranks_do_not_depend_on_the_number_of_buckets(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    ranks = [{r.id: r._rank for r in S.spread_rank(df, "y", ["id"], 3, 2000, per_bucket=n).collect()} for n in (2000, 300, 11)]
    assert ranks[0] == ranks[1] == ranks[2]


def test_one_rule_draws_the_rows_of_trees_at_every_size(spark):
    for total, trees, rows in ((40, 10, 64), (3000, 20, 64), (20_000, 5, 32)):
        df = spark.range(total).select("id", F.col("id").cast("double").alias("x"))
        drawn = tree_samples(df, ["x"], 0, trees, rows, total, 42, F.xxhash64("id"))
        sizes = {r.tree_id: r["count"] for r in drawn.groupBy("tree_id").count().collect()}
        assert drawn.count() == drawn.distinct().count() and set(sizes) == set(range(trees))
        rate = min(1.0, rows * (1 + 6 / rows**0.5) / total)
        assert all(abs(n - rate * total) <= 6 * (rate * total * (1 - rate)) ** 0.5 + 1e-9 for n in sizes.values())
