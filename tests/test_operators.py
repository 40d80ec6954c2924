"""Operators on small inputs that can be checked by hand or by brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.functions import geo
from loopweave.operators import (aggregates, clustering, dimensions, moments, outliers, pairs,
                                 projection, quality, regression, reshape, sampling, spatial)

D = dt.date


def test_history_collapses_same_start_and_keeps_last_open(rows):
    versions = rows("s long, d date, n int", [(1, D(2010, 1, 1), 2), (1, D(2010, 1, 1), 1),
                                              (1, D(2010, 2, 1), 3), (2, D(2010, 1, 5), 9)])
    got = {tuple(r) for r in dimensions.station_history(versions, "s", "d", tie_break=["n"])
           .select("s", "d", "eff_end", "n").collect()}
    assert got == {(1, D(2010, 1, 1), D(2010, 2, 1), 1), (1, D(2010, 2, 1), None, 3),
                   (2, D(2010, 1, 5), None, 9)}


def test_numbered_history_equals_history_plus_ids(rows):
    random.seed(1)
    data = [(random.randrange(2000), D(2010, 1, 1) + dt.timedelta(random.randrange(900)), i)
            for i in range(3000)]
    versions = rows("s long, d date, n int", data)
    two = dimensions.ordered_ids(dimensions.station_history(versions, "s", "d", tie_break=["n"]),
                                 ["s", "d"])
    one = dimensions.numbered_history(versions, "s", "d", tie_break=["n"])
    assert sorted(map(tuple, one.select(two.columns).collect())) == sorted(map(tuple,
                                                                              two.collect()))
    ids = sorted(r["id"] for r in one.collect())
    assert ids == list(range(1, len(ids) + 1))


def test_version_at(rows):
    history = rows("id long, sensor long, eff_start date, eff_end date",
                   [(10, 1, D(2010, 1, 1), D(2010, 2, 1)), (11, 1, D(2010, 2, 1), None)])
    facts = rows("s long, day date", [(1, D(2009, 12, 31)), (1, D(2010, 1, 1)),
                                      (1, D(2010, 2, 1)), (7, D(2010, 2, 1))])
    got = {tuple(r) for r in dimensions.version_at(facts, history, "s", "day", "sensor").collect()}
    assert got == {(1, D(2009, 12, 31), -1), (1, D(2010, 1, 1), 10), (1, D(2010, 2, 1), 11),
                   (7, D(2010, 2, 1), -1)}


def test_dense_ids_are_stable_under_repartitioning(rows):
    df = rows("a long, b string", [(i % 50, f"x{i}") for i in range(500)])
    one = {tuple(r) for r in dimensions.dense_ids(df, ["a", "b"]).collect()}
    two = {tuple(r) for r in dimensions.dense_ids(df.repartition(13), ["a", "b"]).collect()}
    assert one == two
    assert sorted(r[2] for r in one) == list(range(1, 501))


def test_ordered_ids_keep_null_keys_and_split_hot_ones(rows):
    df = rows("a string, b long", [("x", i) for i in range(300)] + [(None, 1), (None, None), ("w", 5)])
    got = {(r.a, r.b): r.id for r in dimensions.ordered_ids(df.repartition(7), ["a", "b"]).collect()}
    assert sorted(got.values()) == list(range(1, 304))
    assert got[None, None] == 1 and got[None, 1] == 2 and got["w", 5] == 3 and got["x", 299] == 303
    last = dimensions.ordered_ids(df, ["a", "b"], nulls_last=True)
    got = {(r.a, r.b): r.id for r in last.collect()}
    assert got["w", 5] == 1 and got[None, 1] == 302 and got[None, None] == 303
    assert dimensions.ordered_ids(df.limit(0), ["a"]).count() == 0


def test_unmatched_keeps_null_keys(rows):
    facts, parents = rows("k long", [(1,), (2,), (None,)]), rows("id long", [(1,)])
    assert {r[0] for r in dimensions.unmatched(facts, parents, {"k": "id"}).collect()} == {2, None}


def readings(rows, data):
    return rows("station int, slot int, flow double, speed double, at int, bad boolean", data)


def test_profiles_strict_and_lenient(rows):
    full = [(1, s, float(s), 10.0 + s, s, False) for s in range(4)]
    twice = [(1, 2, 2.5, 12.5, 9, False)]
    gap = [(2, s, 1.0, 1.0, s, False) for s in range(3)]
    bad = [(3, s, 1.0, None if s == 1 else 1.0, s, s == 1) for s in range(4)]
    df = readings(rows, full + twice + gap + bad)
    strict = reshape.slot_profiles(df, ["station"], "slot", ["flow", "speed"], slots=4, how="first",
                                   time="at", bad="bad").collect()
    assert [(r["station"], r["flow"], r["speed"]) for r in strict] == [
        (1, [0.0, 1.0, 2.0, 3.0], [10.0, 11.0, 12.0, 13.0])]
    lenient = {r["station"]: r for r in reshape.slot_profiles(
        df, ["station"], "slot", ["flow", "speed"], slots=4, strict=False).collect()}
    assert lenient[1]["flow"] == [0.0, 1.0, 2.5, 3.0]
    assert lenient[2]["flow"] == [1.0, 1.0, 1.0, 0.0]
    assert lenient[3]["speed"] == [1.0, 0.0, 1.0, 1.0]


def test_full_day_profile_spans_blocks(rows):
    data = [(1, s, float(s), s * 2.0, s, False) for s in range(288)]
    random.shuffle(data)
    row = reshape.slot_profiles(readings(rows, data), ["station"], "slot", ["flow", "speed"]).first()
    assert row["flow"] == [float(s) for s in range(288)]
    assert row["speed"] == [s * 2.0 for s in range(288)]


@pytest.mark.parametrize("slots", [4, 288])
def test_profiles_take_one_shuffle(rows, slots):
    profiles = reshape.slot_profiles(readings(rows, [(1, 0, 1.0, 1.0, 0, False)]), ["station"],
                                     "slot", ["flow", "speed"], slots=slots)
    plan = profiles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("how", ["max", "avg", "first"])
def test_packed_readings_give_the_profiles_of_single_ones(rows, how, monkeypatch):
    monkeypatch.setattr(reshape, "_PACKED", 50)
    random.seed(7)
    data = [(random.choice([None, 1, 2, "3"]), random.randrange(-1, 289), random.choice([None, 1.5, -2.0, 8.0]),
             i, random.random() < 0.001) for i in range(3000)]
    data = [(None if k is None else str(k), *rest) for k, *rest in data]
    df = rows("k string, slot int, v double, at int, bad boolean", data).repartition(3)
    got = {r["k"]: r["v"] for r in reshape.slot_profiles(
        df, ["k"], "slot", ["v"], how=how, time="at", strict=False).collect()}
    assert set(got) == {None, "1", "2", "3"}
    for k, profile in got.items():
        for slot in range(288):
            values = [v for key, s, v, *_ in data if (key, s) == (k, slot)]
            known = [v for v in values if v is not None]
            want = {"max": max(known, default=None), "first": values[0] if values else None,
                    "avg": sum(known) / len(known) if known else None}[how]
            assert profile[slot] == pytest.approx(want or 0.0)
    nested = reshape.slot_profiles(df.withColumn("k", F.struct("k")), ["k"], "slot", ["v"], how=how,
                                   time="at", strict=False).collect()
    assert {r["k"]["k"]: r["v"] for r in nested}.keys() == got.keys()


def test_select_measure_checks_the_count(rows):
    with pytest.raises(ValueError):
        reshape.select_measure(rows("k int, total_flow_0000 double", [(1, 1.0)]), "total_flow",
                               ["k"])


def test_one_hot_refuses_too_many_values(rows):
    with pytest.raises(ValueError):
        reshape.one_hot(rows("a int", [(i,) for i in range(5)]), "a", most=4)


def test_precipitation_pairs(rows):
    text = " 0100 00012  0200 00000I 2500 00012 "
    records = rows("r int, values string, value_count int", [(1, text, 3), (2, text, 4)])
    got = [tuple(r) for r in reshape.explode_precipitation(records).collect()]
    assert got == [(1, 1, 12, None, None), (1, 2, 0, "I", None), (1, 25, 12, None, None)]
    assert [r["r"] for r in reshape.miscounted_precipitation(records).collect()] == [2]


def brute_pairs(data, tolerance):
    out = set()
    for (b1, g1, v1), (b2, g2, v2) in itertools.product(data, data):
        if b1 == b2 and v1 * (1 - tolerance) <= v2 <= v1 * (1 + tolerance):
            out.add((g1, g2))
    return out


@pytest.mark.parametrize("tolerance", [0.1, 0.01, 0.5])
def test_similar_pairs_equal_brute_force(rows, tolerance):
    random.seed(3)
    data = [(random.randrange(6), random.randrange(25),
             random.choice([0.0, -2.0, 1.0, 1.1, 1.21, math.exp(random.uniform(-2, 4))]))
            for _ in range(300)]
    got = {tuple(r) for r in pairs.similar_pairs(rows("b int, g int, v double", data), "b", ["g"],
                                                 "v", tolerance).collect()}
    assert got == brute_pairs(data, tolerance)


def haversine(a, b):
    la, lo, lb, mo = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))


@pytest.mark.parametrize("base", [(32.7, -117.1), (0.0, 0.0), (-65.0, 12.0)])
def test_near_join_equals_brute_force(rows, base):
    random.seed(5)
    def place(n):
        return [(i, base[0] + random.uniform(-.1, .1), base[1] + random.uniform(-.1, .1),
                 random.randrange(3)) for i in range(n)]
    left, right = place(120), place(120)
    schema = "id int, latitude double, longitude double, fwy int"
    joined = spatial.near_join(rows(schema, left), rows(schema, right), 3000, {"fwy": "fwy"})
    got = {(r["id"], r["id_r"]) for r in joined.collect()}
    want = set()
    for a in left:
        near = [b[0] for b in right if a[3] == b[3] and haversine(a[1:3], b[1:3]) < 3000]
        want |= {(a[0], b) for b in near} or {(a[0], None)}
    assert got == want


def test_point_without_place_gets_no_area(rows):
    rings = spatial.rectangle_rings(rows("zip int, x0 double, y0 double, x1 double, y1 double",
                                         [(7, 0.0, 0.0, 1.0, 1.0), (3, 0.5, 0.5, 2.0, 2.0)]), "zip")
    points = rows("id int, latitude double, longitude double",
                  [(1, 0.7, 0.7), (2, None, 0.5), (3, 9.0, 9.0), (4, 0.2, 0.2)])
    got = {r["id"]: r["area"] for r in spatial.containing_area(points, rings, "zip",
                                                               "area").collect()}
    assert got == {1: 3, 2: None, 3: None, 4: 7}


def test_valid_and_rejects_cover_the_input(rows):
    df = rows("id int, avg_occupancy double", [(1, 0.5), (2, 1.5), (3, None), (None, 0.1)])
    valid, rejects = quality.validate(df, quality.observation_rules(), "id")
    assert [r["id"] for r in valid.collect()] == [1]
    got = {(r["record_no"], r["rule_name"]) for r in rejects.collect()}
    assert got == {(2, "avg_occupancy in [0, 1]"), (3, "avg_occupancy in [0, 1]"),
                   (None, "id not null")}
    record = rejects.filter("record_no = 2").first()
    assert record["values"] == {"avg_occupancy": "1.5"}


def test_parity_rule(rows):
    df = rows("num int, direction string", [(5, "E"), (8, "E")])
    assert quality.valid_rows(df, [quality.parity_rule()]).count() == 2
    assert [r["num"] for r in quality.valid_rows(df, [quality.parity_rule(True)]).collect()] == [8]


def test_nan_covariance_matches_numpy(rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    x[rng.random(x.shape) < .2] = np.nan
    x[:, 4] = np.nan
    df = rows("v array<double>", [(r.tolist(),) for r in x]).repartition(5)
    got = moments.matrix(moments.nan_covariance(df, "v"))
    mean = np.nan_to_num(np.nanmean(x[:, :4], axis=0))
    for i in range(4):
        for j in range(4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = (x[both, i] * x[both, j]).mean() - mean[i] * mean[j]
            assert abs(got[i, j] - want) < 1e-12
    assert not got[4].any()
    means = {r["i"]: r["mean"] for r in moments.nan_mean(df, "v").collect()}
    assert means[4] == 0.0


def test_covariance_keeps_digits_of_large_values(rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) + 1e8
    df = rows("v array<double>", [(r.tolist(),) for r in x]).repartition(4)
    got = moments.matrix(moments.sample_covariance(df, "v"))
    assert np.allclose(got, np.cov(x.T), rtol=1e-6)


def test_pca_reconstructs_with_all_components(rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6))
    df = rows("id int, v array<double>", [(i, r.tolist()) for i, r in enumerate(x)])
    basis = projection.fit(df, "v", 6)
    assert abs(basis.ratios.sum() - 1) < 1e-9
    back = df.withColumn("c", projection.project(F.col("v"), basis)).withColumn(
        "r", projection.reconstruct(F.col("c"), basis))
    assert projection.with_errors(back, "v", "r").agg(F.max("mse")).first()[0] < 1e-18
    variances = x.var(axis=0, ddof=1).sum()
    coefficient_variance = aggregates.vector_moments(back, "c").first()["variance"]
    assert abs(sum(coefficient_variance) - variances) < 1e-8
    saved = projection.Basis.from_df(basis.to_df(df.sparkSession))
    assert np.allclose(saved.components, basis.components)
    with pytest.raises(ValueError):
        projection.fit(df, "v", 7)


def test_null_vectors_stay_null(rows):
    basis = projection.Basis(np.zeros(2), np.eye(2), np.array([.5, .5]))
    df = rows("id int, v array<double>", [(1, [1.0, 2.0]), (2, None), (3, [3.0, 4.0])]).coalesce(1)
    got = {r["id"]: r["c"] for r in df.withColumn("c", projection.project(F.col("v"), basis))
           .collect()}
    assert got == {1: [1.0, 2.0], 2: None, 3: [3.0, 4.0]}


def test_trimmed_kmeans_finds_the_planted_points(rows):
    rng = np.random.default_rng(7)
    near = np.concatenate([rng.normal(0, .3, (100, 2)), rng.normal(5, .3, (100, 2))])
    far = np.array([[40.0, 0.0], [0.0, 60.0], [-50.0, -50.0]])
    data = [(i, r.tolist()) for i, r in enumerate(np.concatenate([near, far]))]
    df = rows("id int, v array<double>", data)
    start = np.array([[1.0, 1.0], [4.0, 4.0]])
    found = clustering.kmeans_outliers(df, ["id"], "v", 2, 3, centres=start)
    assert {r["id"] for r in found.collect()} == {200, 201, 202}


def test_empty_cluster_keeps_its_centre(rows):
    df = rows("id int, v array<double>", [(i, [float(i % 3)]) for i in range(30)])
    centres = clustering.lloyd(df, "v", np.array([[1.0], [1000.0]]))
    assert np.allclose(centres, [[1.0], [1000.0]])


def test_mahalanobis_needs_fit_and_full_rank(rows):
    flat = rows("v array<double>", [([1.0, float(i)],) for i in range(10)])
    with pytest.raises(ValueError):
        outliers.Mahalanobis("v").fit(flat)
    with pytest.raises(ValueError):
        outliers.Mahalanobis("v").detect(flat)
    with pytest.raises(ValueError):
        outliers.TrimmedKMeans(["v"], "v", 2, 1).detect(flat)


def test_share_per_group_takes_the_ceiling(rows):
    data = [(0, i) for i in range(333)] + [(1, i) for i in range(3)]
    df = rows("g int, k int", data)
    for part in (df, df.repartition(7)):
        taken = sampling.share_per_group(part, "g", ["k"], 0.05).groupBy("g").count().collect()
        assert {r["g"]: r["count"] for r in taken} == {0: 17, 1: 1}


def test_most_common_breaks_ties_by_smallest(rows):
    df = rows("s int, a string, b int", [(1, "x", 2), (1, "x", 2), (1, "a", 9), (1, "a", 9),
                                         (2, "q", 1)])
    got = {tuple(r) for r in aggregates.most_common(df, ["s"], ["a", "b"]).collect()}
    assert got == {(1, "a", 9, 2), (2, "q", 1, 1)}


def test_dips_use_the_day_of_the_rounded_bucket(rows):
    # 23:50 rounds to the next day, where the day average is another one.
    at = dt.datetime
    df = rows("station_id int, time timestamp_ntz, avg_speed double, samples int", [
        (1, at(2024, 1, 1, 10), 100.0, 1), (1, at(2024, 1, 1, 23, 50), 10.0, 1),
        (1, at(2024, 1, 2, 12), 20.0, 1)])
    assert aggregates.dips_below_day(df, 30).count() == 0
    assert aggregates.dips_below_day(df, 30, share=0.7).first()["day_avg"] == 20.0


def test_constant_columns_standardise_to_zero(rows):
    got = regression.standardise(rows("a double, b double", [(1.0, 5.0), (3.0, 5.0)]), ["a", "b"])
    assert {r["b"] for r in got.collect()} == {0.0}


def test_best_k(rows):
    costs = rows("k int, cost double", [(1, 10e11), (2, 5e11), (3, 4.5e11), (4, 4.4e11)])
    assert clustering.best_k(costs).first()["k"] == 2
    with pytest.raises(Exception, match="below the threshold"):
        clustering.best_k(costs.filter("k < 3")).collect()
