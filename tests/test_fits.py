"""Fitted models against plain numpy, brute force and Spark's own fits."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from loopweave.catalog import learning
from loopweave.operators import clustering, gram, regression

RNG = np.random.default_rng(11)


def points(n=240, width=5, groups=3):
    centres = RNG.normal(0, 4, (groups, width))
    return centres[RNG.integers(0, groups, n)] + RNG.normal(0, 1, (n, width))


@pytest.fixture
def vectors(spark):
    return lambda x, parts=5: spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)


# --- several models at once


def plain_lloyd(x, centres, steps):
    c = np.array(centres, dtype=float)
    for _ in range(steps):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c, float(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())


def test_models_step_together_as_they_would_alone(vectors):
    x = points()
    given = {k: x[:k] + 0.5 for k in range(1, 7)}
    given[3][2] = 1000.0  # never nearest: keeps its place
    for steps in (1, 4):
        made = clustering.all_models(vectors(x), "v", given, steps, tolerance=0.0)
        for k, start in given.items():
            centres, cost = plain_lloyd(x, start, steps)
            assert np.allclose(made[k][0], centres) and made[k][1] == pytest.approx(cost)


def test_curve_falls_and_finds_the_groups(vectors):
    x = points(400, 4, 4)
    costs = [r.cost for r in clustering.cost_curve(vectors(x), "v", most=6).orderBy("k").collect()]
    assert costs[0] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    assert costs[3] < costs[0] / 3 and costs[5] < costs[2]


def test_a_curve_that_still_falls_at_its_end_is_whole(spark):
    """Costs grow with the rows: all fifteen rows come, and no k is best."""
    spread = RNG.normal(0, 50, (120, 3))
    tables = SimpleNamespace(spark=spark, embeddings=spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(spread)], "vec_id long, embedding array<double>"))
    curve = learning.m08(tables).orderBy("k").collect()
    assert [r.k for r in curve] == list(range(1, 16)) and {r.best_k for r in curve} == {None}
    assert min(r.change for r in curve[1:]) > 0 and curve[0].cost > curve[14].cost


def test_seeding_is_repeatable_and_bounded(vectors):
    x = points(600)
    one = clustering.candidates(vectors(x, 2), "v", 5)
    two = clustering.candidates(vectors(x, 9), "v", 5)
    assert np.allclose(one[0], two[0]) and np.array_equal(one[1], two[1])
    assert one[1].sum() == 600 and len(one[0]) < 200
    few, weights = clustering.candidates(vectors(np.ones((30, 2))), "v", 4)
    assert len(few) == 1 and clustering.starts(few, weights, 3).shape == (3, 2)
    with pytest.raises(ValueError, match="no vectors"):
        clustering.candidates(vectors(np.ones((1, 2))).filter("id < 0"), "v", 2)


# --- rows set aside


def plain_trimmed(x, centres, outliers):
    squared = ((x[:, None] - centres[None]) ** 2).sum(2)
    near, far = squared.argmin(1), squared.min(1)
    order = sorted(range(len(x)), key=lambda i: (-far[i], i))
    kept = np.ones(len(x), bool)
    kept[order[:outliers]] = False
    means = np.array([x[kept & (near == j)].mean(0) if (kept & (near == j)).any() else centres[j]
                      for j in range(len(centres))])
    return means, order[:outliers]


@pytest.mark.parametrize("outliers", [0, 1, 17, 239, 500])
def test_one_scan_gives_means_and_farthest(vectors, outliers):
    x = points()
    x[5] = x[9] = x[200] = 50.0  # ties: the smaller id is set aside first
    centres = x[20:23]
    counts, means, far = clustering.trimmed_round(vectors(x, 7), ["id"], "v", centres, outliers)
    want, order = plain_trimmed(x, centres, outliers)
    assert np.allclose(means, want) and [key["id"] for _, key, _ in far] == order
    assert counts.sum() == len(x) - len(order)


def test_farthest_rows_of_the_result(vectors):
    x = points()
    x[5] = x[9] = x[200] = 50.0
    centres = x[20:23]
    for outliers, want in ((2, [5, 9]), (3, [5, 9, 200]), (0, [])):
        rows = clustering.kmeans_outliers(vectors(x), ["id"], "v", 3, outliers, centres=centres,
                                          steps=1)
        assert sorted(r.id for r in rows.collect()) == want


def test_null_vectors_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "a", [0.0]), (None, "b", [9.0]), (2, None, [9.0]),
                                  (3, "c", None), (2, "x", [9.0])],
                                 "k long, s string, v array<double>")
    _, means, far = clustering.trimmed_round(rows, ["k", "s"], "v", np.array([[0.0]]), 2)
    assert [key for _, key, _ in far] == [{"k": None, "s": "b"}, {"k": 2, "s": None}]
    assert means[0][0] == pytest.approx(4.5)
    found = clustering.kmeans_outliers(rows, ["k", "s"], "v", 1, 2, centres=np.array([[0.0]]),
                                       steps=1)
    assert sorted((str(r.k), str(r.s)) for r in found.collect()) == [("2", "None"), ("None", "b")]


def test_a_round_reads_its_input_once(spark, vectors):
    rows = vectors(points(), 4)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = rows.mapInArrow(count, rows.schema)
    clustering.trimmed_round(watched, ["id"], "v", np.zeros((2, 5)), 10)
    assert seen.value == 240
    clustering.lloyd_steps(watched, "v", {k: np.zeros((k, 5)) for k in range(1, 9)})
    assert seen.value == 480


# --- regressions of all groups


def regression_rows(spark, n=900, groups=("a", "b", None)):
    x = RNG.normal(100, 3, (n, 4))
    x[:, 3] = 7.0  # constant
    g = [groups[i % len(groups)] for i in range(n)]
    y = [x[i, 0] * (1 + i % len(groups)) - 2 * x[i, 1] + 0.1 * x[i, 2] + RNG.normal() + 1e6
         for i in range(n)]
    rows = [(i, g[i], float(y[i]), *map(float, x[i])) for i in range(n)]
    return rows, spark.createDataFrame(
        rows, "id long, g string, y double, f0 double, f1 double, f2 double, f3 double")


FEATURES = ["f0", "f1", "f2", "f3"]


def test_groups_equal_least_squares(spark):
    rows, df = regression_rows(spark)
    got = {}
    for r in gram.elastic_nets(df.repartition(9), ["g"], "y", FEATURES, ["id"], train=None).collect():
        got.setdefault(r.g, {})[r.feature] = r
    assert set(got) == {"a", "b", None}
    for g, made in got.items():
        mine = np.array([r[2:] for r in rows if r[1] == g])
        x = np.column_stack([np.ones(len(mine)), mine[:, 1:4]])
        w, *_ = np.linalg.lstsq(x, mine[:, 0], rcond=None)
        assert np.allclose([made[f].weight for f in FEATURES[:3]], w[1:], rtol=1e-6)
        assert made["f3"].weight == 0 and made["f0"].n == 300
        assert made["f0"].intercept == pytest.approx(w[0], rel=1e-9)
        left = ((mine[:, 0] - x @ w) ** 2).sum()
        assert made["f0"].r2 == pytest.approx(1 - left / ((mine[:, 0] - mine[:, 0].mean()) ** 2).sum())


@pytest.mark.parametrize("reg, mix", [(0.3, 0.0), (0.3, 0.5), (1.5, 1.0), (50.0, 0.5)])
def test_penalty_equals_the_library_fit(spark, reg, mix):
    _, df = regression_rows(spark, 300, ("a",))
    got = {r.feature: r for r in gram.elastic_nets(df, ["g"], "y", FEATURES, ["id"], None, reg,
                                                   mix).collect()}
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        df.withColumn("label", F.col("y")))
    want = LinearRegression(regParam=reg, elasticNetParam=mix, tol=1e-12, maxIter=1000).fit(rows)
    assert np.allclose([got[f].weight for f in FEATURES], want.coefficients.toArray(), atol=2e-4)
    assert got["f0"].intercept == pytest.approx(want.intercept, rel=1e-7)


def test_optimality_conditions():
    """At the minimum, each gradient is balanced by the penalty."""
    x = RNG.normal(0, 1, (400, 6)) @ RNG.normal(0, 1, (6, 6))
    y = x @ np.array([3.0, 0, 0, -1, 0, 0.2]) + RNG.normal(0, 1, 400)
    z = np.column_stack([y, x]) - np.column_stack([y, x]).mean(0)
    for reg, mix in ((0.2, 1.0), (0.5, 0.5), (0.1, 0.0)):
        w = gram.solve(400, z.T @ z, reg, mix)
        s, s_y = x.std(axis=0), y.std()
        gradient = z[:, 1:].T @ (z[:, 0] - z[:, 1:] @ w) / 400 / s - reg * (1 - mix) / s_y * w * s
        for j in range(6):
            if w[j]:
                assert gradient[j] == pytest.approx(reg * mix * np.sign(w[j]), abs=1e-8)
            else:
                assert abs(gradient[j]) <= reg * mix + 1e-8


def test_missing_values_and_groups_without_a_side(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, 2.0), (2, "a", None, 3.0), (3, "a", 3.0, float("nan")), (4, "b", 1.0, 1.0)],
        "id long, g string, y double, f double")
    got = {r.g: r for r in gram.elastic_nets(df, ["g"], "y", ["f"], ["id"], None).collect()}
    assert (got["a"].n, got["b"].n) == (1, 1) and got["a"].weight == 0 and got["a"].r2 is None
    none = gram.elastic_nets(df, ["g"], "y", ["f"], ["id"], 0.0).collect()
    assert {(r.g, r.weight, r.n) for r in none} == {("a", None, 0), ("b", None, 0)}
    assert gram.elastic_nets(df.filter("id < 0"), ["g"], "y", ["f"], ["id"]).collect() == []


def test_a_hot_group_and_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(gram, "HELD", 40)  # tasks pass states on all the time
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("g"),
        (F.col("id") * 2.5 + 3).alias("y"), F.col("id").cast("double").alias("f")).repartition(20)
    got = gram.elastic_nets(df, ["g"], "y", ["f"], ["id"], None).collect()
    assert len(got) == 501 and {round(r.weight, 6) for r in got} == {2.5}
    assert sum(r.n for r in got) == 3000 and next(r.n for r in got if r.g == -1) == 1000


def test_listed_groups(spark):
    _, df = regression_rows(spark)
    got = regression.per_group(df, "g", ["a"], "y", FEATURES, ["id"])
    assert got.columns == ["g", "feature", "weight", "r2"] and {r.g for r in got.collect()} == {"a"}
