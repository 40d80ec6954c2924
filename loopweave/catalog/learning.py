"""Statistics and learning (M)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loopweave.catalog.reading import coefficient_rows
from loopweave.catalog.registry import query
from loopweave.catalog.reshaping import sample_basis
from loopweave.operators import (aggregates, clustering, gram, moments, outliers, projection, regression,
                                 reshape, sampling)
from loopweave.plans import profiles
from loopweave.session import staged

CELLS = """cells as (select vec_id, label, i, i % 5 as c, embedding[i + 1]::double as x,
    i * 0.001::double as mean, sqrt(case when i % 5 = 4 then 12 else 13 end::double) as root
    from embeddings, range(64) r(i))"""
COEFFICIENTS = f"""{CELLS}, coef as (select vec_id, label, c, sum((x - mean) / root) as v
    from cells group by vec_id, label, c)"""


def vectors_of(t):
    return t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))


def part_vectors(t):
    return vectors_of(t).withColumn("day_of_week", (F.col("vec_id") % 7 + 1).cast("int"))


@query("m01_pca_fit")
def m01(t):
    bases = projection.fit_parts(part_vectors(t), "embedding", profiles.day_parts(), 5)
    out = None
    for name, basis in bases.items():
        rows = basis.to_df(t.spark).select(F.lit(name).alias("part"), F.posexplode("ratios").alias(
            "component", "ratio"))
        out = rows if out is None else out.unionByName(rows)
    return aggregates.cumulative_share(out, "component", "ratio", ["part"])


@query("m01_pca_invariants", """
    select c::int as component, true as unit_length, true as orthogonal, true as falling
    from range(10) r(c)""")
def m01_invariants(t):
    basis = projection.fit(vectors_of(t), "embedding", 10)
    gram = basis.components @ basis.components.T
    rows = [(i, bool(abs(gram[i, i] - 1) < 1e-9),
             bool(np.abs(np.delete(gram[i], i)).max() < 1e-9),
             bool(i == 0 or basis.ratios[i] <= basis.ratios[i - 1] + 1e-12)) for i in range(10)]
    return t.spark.createDataFrame(
        rows, "component int, unit_length boolean, orthogonal boolean, falling boolean")


@query("m01_pca_per_measure")
def m01_measures(t):
    keys = ["station_id"]
    fitted = projection.fit_measures(coefficient_rows(t), ["total_flow", "occupancy", "speed"],
                                     keys, 4)
    out = None
    for name, model in fitted.items():
        rows = model["basis"].to_df(t.spark).select(
            F.lit(name).alias("measure"), F.posexplode("ratios").alias("component", "ratio"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("m02_project", f"""
    with {COEFFICIENTS} select vec_id, c::int as component, round(v, 8) + 0.0::double as value
    from coef""")
def m02(t):
    rows = projection.transform(t.embeddings, "embedding", sample_basis(), ["vec_id"])
    values = F.array(*[f"V{i}" for i in range(5)])
    return rows.select("vec_id", F.posexplode(values).alias("component", "value")).withColumn(
        "value", F.round("value", 8))


REBUILT = f"""{COEFFICIENTS}, rebuilt as (select cells.vec_id, cells.label, i, x,
    coef.v / root + mean as y from cells join coef using (vec_id, c))"""


def rebuilt(t, centre=True):
    basis = sample_basis()
    coefficients = projection.project(F.col("embedding"), basis, centre)
    return t.embeddings.select("vec_id", "label", "embedding", coefficients.alias("c")).withColumn(
        "rebuilt", projection.reconstruct(F.col("c"), basis, centre))


@query("m03_reconstruct", f"""
    with {REBUILT} select vec_id, i::int as slot, round(y, 8) + 0.0::double as value
    from rebuilt""")
def m03(t):
    rows = rebuilt(t).select("vec_id", F.posexplode("rebuilt").alias("slot", "value"))
    return rows.withColumn("value", F.round("value", 8))


@query("m04_reconstruction_error", f"""
    with {REBUILT} select vec_id, round(avg((x - y) * (x - y)), 9) as mse,
      round(sqrt(avg((x - y) * (x - y))), 9) as rmse,
      round(sqrt(avg((x - y) * (x - y))) / (max(x) - min(x)), 9) as nrmse
    from rebuilt group by vec_id""")
def m04(t):
    return projection.with_errors(rebuilt(t), "embedding", "rebuilt").select(
        "vec_id", *[F.round(c, 9).alias(c) for c in ("mse", "rmse", "nrmse")])


@query("m05_group_average_error", f"""
    with {COEFFICIENTS}, means as (select label, c, avg(v) as v from coef group by label, c),
    picked as (select vec_id from (select vec_id, row_number() over (partition by label
        order by md5('|' || vec_id::varchar), vec_id) as r, count(*) over (partition by label) as n
      from embeddings) where r <= ceil(n * 0.05::double))
    select vec_id, cells.label, round(avg(power(x - (means.v / root + mean), 2)), 9) as mse
    from cells join picked using (vec_id) join means on means.label = cells.label
      and means.c = cells.c group by vec_id, cells.label""")
def m05(t):
    basis = sample_basis()
    sample = sampling.share_per_group(t.embeddings, "label", ["vec_id"], 0.05).drop("sample_rank")
    projected = t.embeddings.select("label", projection.project(F.col("embedding"), basis)
                                    .alias("c"))
    errors = projection.group_average_error(projected, "label", "c", "embedding", basis, sample)
    return errors.select("vec_id", "label", F.round("mse", 9).alias("mse"))


@query("m06_fit_one_project_others")
def m06(t):
    return projection.explain_others(vectors_of(t), "embedding", "label", 0, 20)


def clustered(t, k=5, clusters=7):
    basis = projection.fit(vectors_of(t), "embedding", k)
    rows = staged(t.embeddings.select(
        "vec_id", "embedding", projection.project(F.col("embedding"), basis).alias("c")), "projected")
    return clustering.label(rows, "c", clustering.fit(rows, "c", clusters))


@query("m07_kmeans_on_coefficients")
def m07(t):
    profile = clustering.cluster_profiles(clustered(t), "embedding")
    return profile.select("cluster", "n", "fraction", F.size("mean").alias("width"))


@query("m07_cluster_totals", """select count(*) as n, true as shares_sum_to_one from embeddings""")
def m07_totals(t):
    shares = aggregates.label_shares(clustered(t), "cluster")
    return shares.agg(F.sum("n").alias("n"), (F.abs(F.sum("fraction") - 1) < 1e-9)
                      .alias("shares_sum_to_one"))


@query("m08_cost_curve")
def m08(t):
    """The curve, and its best k: null if the costs still change by more at the end of the curve."""
    costs = clustering.cost_curve(vectors_of(t), "embedding")
    best = clustering.best_k(costs, scale=5.0, required=False).scalar()
    return clustering.consecutive_change(costs, "k", "root").withColumn("best_k", best)


def lloyd_sql(most, steps):
    """Unrolled Lloyd steps of the models k = 1 .. ``most`` from constant starting centres."""
    out = [f"""x as materialized (select vec_id, i, embedding[i + 1]::double as v
               from embeddings, range(64) r(i)),
    c0 as (select k, c, i, (c - 2) * 0.01::double as centre
           from range(1, {most + 1}) a(k), range({most}) b(c), range(64) r(i) where c < k)"""]
    for s in range(steps + 1):
        out.append(f"""
    near{s} as materialized (select vec_id, k, c, dist from (select *, row_number() over (
               partition by vec_id, k order by dist, c) as r from (
               select vec_id, k, c, sum(power(v - centre, 2)) as dist from x join c{s} using (i)
               group by vec_id, k, c)) where r = 1),
    m{s} as (select k, c, i, avg(v) as centre from near{s} join x using (vec_id) group by k, c, i),
    c{s + 1} as materialized (select o.k, o.c, o.i, coalesce(m.centre, o.centre) as centre
               from c{s} o left join m{s} m using (k, c, i))""")
    return ",".join(out)


@query("m08_costs_of_given_starts", f"""
    with {lloyd_sql(5, 2)} select k::int as k, round(sum(dist), 8) as cost,
      round(sqrt(sum(dist)), 8) as root from near2 group by k""")
def m08_given(t):
    """Two steps of five models at once, from given centres."""
    given = {k: np.array([np.full(64, (c - 2) * 0.01) for c in range(k)]) for k in range(1, 6)}
    costs = clustering.cost_curve(vectors_of(t), "embedding", iterations=2, given=given)
    return costs.withColumns({c: F.round(c, 8) for c in ("cost", "root")})


CENTRES = np.array([np.full(64, v) for v in (-0.02, 0.0, 0.03)])
NEAREST = """x as (select vec_id, i, embedding[i + 1]::double as v from embeddings, range(64) r(i)),
    d as (select vec_id, c, sum(power(v - centre, 2)) as dist from x,
            (values (0, -0.02::double), (1, 0.0::double), (2, 0.03::double)) k(c, centre)
          group by vec_id, c),
    near as (select vec_id, c, dist from (select *, row_number() over (partition by vec_id
               order by dist, c) as r from d) where r = 1)"""


@query("m09_lloyd_step", f"""
    with {NEAREST} select near.c::int as cluster, x.i::int as slot, count(*) as n,
      round(avg(v), 9) + 0.0::double as mean from near join x using (vec_id) group by 1, 2""")
def m09(t):
    step = clustering.lloyd_step(t.embeddings, "embedding", CENTRES)
    return step.select("cluster", "n", F.posexplode("mean").alias("slot", "mean")).withColumn(
        "mean", F.round("mean", 9))


@query("m10_trimmed_step", f"""
    with {NEAREST}, kept as (select * from (select *, row_number() over (order by dist desc, vec_id)
        as r from near) where r > 20)
    select kept.c::int as cluster, x.i::int as slot, count(*) as n,
      round(avg(v), 9) + 0.0::double as mean from kept join x using (vec_id) group by 1, 2""")
def m10_step(t):
    step = clustering.trimmed_step(t.embeddings, ["vec_id"], "embedding", CENTRES, 20)
    return step.select("cluster", "n", F.posexplode("mean").alias("slot", "mean")).withColumn(
        "mean", F.round("mean", 9))


def trimmed_sql(steps, outliers=20):
    """``near{i}`` and ``kept{i}`` of unrolled trimmed steps from the fixed centres."""
    out = ["""x as materialized (select vec_id, i, embedding[i + 1]::double as v
               from embeddings, range(64) r(i)),
    c0 as (select c, i, centre from (values (0, -0.02::double), (1, 0.0::double),
             (2, 0.03::double)) k(c, centre), range(64) r(i))"""]
    for s in range(steps):
        out.append(f"""
    near{s} as materialized (select vec_id, c, dist from (select *, row_number() over (
               partition by vec_id order by dist, c) as r from (
               select vec_id, c, sum(power(v - centre, 2)) as dist from x join c{s} using (i)
               group by vec_id, c)) where r = 1),
    far{s} as (select * from (select *, row_number() over (order by dist desc, vec_id) as r
               from near{s}) where r <= {outliers}),
    kept{s} as (select * from near{s} where vec_id not in (select vec_id from far{s})),
    c{s + 1} as materialized (select c, i, avg(v) as centre from kept{s} join x using (vec_id)
               group by c, i)""")
    return ",".join(out)


@query("m10_kmeans_outliers", f"""
    with {trimmed_sql(4)} select vec_id, c::int as cluster, round(dist, 9) as distance from far3""")
def m10(t):
    """The rows set aside in the fourth step from fixed centres."""
    found = clustering.kmeans_outliers(t.embeddings, ["vec_id"], "embedding", 3, 20,
                                       centres=CENTRES, steps=4)
    return found.select("vec_id", "cluster", F.round("distance", 9).alias("distance"))


@query("m10_labels_after_two_steps", f"""
    with {trimmed_sql(2)} select n.vec_id, n.c::int as cluster, round(n.dist, 9) as distance,
      f.vec_id is not null as outlier from near1 n left join far1 f using (vec_id)""")
def m10_labels(t):
    rows = clustering.kmeans_with_outliers(t.embeddings, ["vec_id"], "embedding", 3, 20,
                                           centres=CENTRES, steps=2)
    return rows.select("vec_id", "cluster", F.round("distance", 9).alias("distance"), "outlier")


@query("m10_converged_outliers")
def m10_converged(t):
    """The same, from hashed rows as starting centres until the centres rest."""
    found = clustering.kmeans_outliers(t.embeddings, ["vec_id"], "embedding", 4, 15)
    return found.select("vec_id", "cluster", "distance")


MAHALANOBIS = """s as (select avg(l_quantity) as mx, avg(l_extendedprice) as my,
      var_samp(l_quantity) as a, var_samp(l_extendedprice) as d,
      covar_samp(l_quantity, l_extendedprice) as b from lineitem),
    m as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice,
            sqrt((d * power(l_quantity - mx, 2) - 2 * b * (l_quantity - mx) * (l_extendedprice - my)
                  + a * power(l_extendedprice - my, 2)) / (a * d - b * b)) as distance
          from lineitem, s),
    lim as (select avg(distance) as mean, stddev_pop(distance) as std, var_pop(distance) as var
            from m)"""


def mahalanobis(t, spread, threshold):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array(
        "l_quantity", "l_extendedprice").alias("v"))
    detector: outliers.Detector = outliers.Mahalanobis("v", spread).fit(rows)
    found = detector.detect(rows, threshold)
    return found.select("l_orderkey", "l_linenumber", "l_partkey",
                        F.round("distance", 6).alias("distance"))


@query("m11_mahalanobis", f"""
    with {MAHALANOBIS} select l_orderkey, l_linenumber, l_partkey, round(distance, 6) as distance
    from m, lim where distance > mean + std * 1.0""")
def m11(t):
    return mahalanobis(t, "std", 1.0)


@query("m11_mahalanobis_variance", f"""
    with {MAHALANOBIS} select l_orderkey, l_linenumber, l_partkey, round(distance, 6) as distance
    from m, lim where distance > mean + var * 2.0""")
def m11_variance(t):
    return mahalanobis(t, "variance", 2.0)


@query("m12_standardise", """
    select l_orderkey, l_linenumber, l_partkey,
      round((l_quantity - avg(l_quantity) over ()) / stddev_samp(l_quantity) over (), 6)
        + 0.0::double as l_quantity,
      round((l_extendedprice - avg(l_extendedprice) over ())
        / stddev_samp(l_extendedprice) over (), 6) + 0.0::double as l_extendedprice
    from lineitem""")
def m12(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                             "l_extendedprice")
    scaled = regression.standardise(rows, ["l_quantity", "l_extendedprice"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


FEATURES = ["l_quantity", "l_discount", "l_tax", "Field_sourceCol_l_returnflag_value_A",
            "Field_sourceCol_l_returnflag_value_N", "Field_sourceCol_l_linestatus_value_F"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def regression_rows(t):
    rows = reshape.one_hot(t.lineitem, "l_returnflag", ["A", "N", "R"])
    return reshape.one_hot(rows, "l_linestatus", ["F", "O"])


@query("m13_label_and_features", """
    select l_extendedprice as label, l_quantity as first_feature, 6 as n from lineitem""")
def m13(t):
    from pyspark.ml.functions import vector_to_array

    rows = regression.labelled_features(regression_rows(t), "l_extendedprice", FEATURES)
    x = vector_to_array("features")
    return rows.select("label", x[0].alias("first_feature"), F.size(x).alias("n"))


@query("m14_train_test_split", """
    select l_orderkey, l_linenumber, l_partkey, substr(md5('47|' || l_orderkey || '|' ||
      l_linenumber || '|' || l_partkey), 1, 8) < 'b3333333' as train from lineitem""")
def m14(t):
    return t.lineitem.select(*KEYS, sampling.below(0.7, *KEYS, salt="47").alias("train"))


@query("m15_linear_regression_one_feature", """
    select round(regr_slope(l_extendedprice, l_quantity), 5) as slope,
      round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept,
      round(regr_r2(l_extendedprice, l_quantity), 8) as r2 from lineitem""")
def m15_one(t):
    result = regression.linear_regression(t.lineitem, "l_extendedprice", ["l_quantity"], KEYS,
                                          train=None)
    return result.weights.select(F.round("weight", 5).alias("slope"),
                                 F.round(F.lit(result.intercept), 4).alias("intercept"),
                                 F.round(F.lit(result.r2), 8).alias("r2"))


@query("m15_linear_regression")
def m15(t):
    result = regression.linear_regression(regression_rows(t), "l_extendedprice", FEATURES, KEYS)
    return result.weights.withColumn("r2", F.lit(result.r2))


#: Normal equations of three features, solved by determinants, on the training rows of m14.
DETERMINANT = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_S = ["s11", "s12", "s13", "s12", "s22", "s23", "s13", "s23", "s33"]


def _cramer(column):
    cells = [f"s{i + 1}y" if j == column else _S[3 * i + j] for i in range(3) for j in range(3)]
    return f"{DETERMINANT.format(*cells)} / {DETERMINANT.format(*_S)}"


GROUP_FITS = f"""
    r as (select l_returnflag, l_extendedprice as y, l_quantity as a, l_discount as b, l_tax as c,
            substr(md5('47|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 8)
              < 'b3333333' as train from lineitem),
    s as (select l_returnflag, count(*) as n, avg(y) as my, avg(a) as ma, avg(b) as mb, avg(c) as mc,
            var_pop(a) as s11, covar_pop(a, b) as s12, covar_pop(a, c) as s13, var_pop(b) as s22,
            covar_pop(b, c) as s23, var_pop(c) as s33, covar_pop(a, y) as s1y, covar_pop(b, y) as s2y,
            covar_pop(c, y) as s3y from r where train group by 1),
    w as (select *, {_cramer(0)} as w1, {_cramer(1)} as w2, {_cramer(2)} as w3 from s),
    f as (select *, my - w1 * ma - w2 * mb - w3 * mc as w0 from w),
    q as (select l_returnflag, 1 - sum(power(y - w0 - w1 * a - w2 * b - w3 * c, 2))
            / (var_pop(y) * count(*)) as r2 from r join f using (l_returnflag)
          where not r.train group by 1)"""


@query("m15_regression_per_group", f"""
    with {GROUP_FITS} select l_returnflag, u.feature, round(u.weight, 4) as weight, round(r2, 8) as r2
    from f join q using (l_returnflag), unnest([{{'feature': 'l_quantity', 'weight': w1}},
      {{'feature': 'l_discount', 'weight': w2}}, {{'feature': 'l_tax', 'weight': w3}}]) t(u)""")
def m15_groups(t):
    found = regression.per_group(t.lineitem, "l_returnflag", ["A", "N", "R"], "l_extendedprice",
                                 ["l_quantity", "l_discount", "l_tax"], KEYS)
    return found.withColumns({"weight": F.round("weight", 4), "r2": F.round("r2", 8)})


@query("m15_slopes_of_all_groups", """
    select l_returnflag, l_linestatus, year(l_shipdate)::int as year, count(*) as n,
      round(regr_slope(l_extendedprice, l_quantity), 5) as weight,
      round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
      round(regr_r2(l_extendedprice, l_quantity), 8) as r2 from lineitem group by 1, 2, 3
    having count(*) > 2""")
def m15_slopes(t):
    """One feature in each flag, status and year, without a penalty."""
    rows = t.lineitem.withColumn("year", F.year("l_shipdate"))
    found = gram.elastic_nets(rows, ["l_returnflag", "l_linestatus", "year"], "l_extendedprice",
                              ["l_quantity"], KEYS, train=None)
    return found.filter("n > 2").select(
        "l_returnflag", "l_linestatus", "year", "n", F.round("weight", 5).alias("weight"),
        F.round("intercept", 3).alias("intercept"), F.round("r2", 8).alias("r2"))


#: With one feature, the elastic net has a closed form: the slope shrinks, or is zero.
@query("m15_penalised_slopes", """
    with s as (select l_returnflag, l_linestatus, stddev_pop(l_quantity) as sx,
        stddev_pop(l_extendedprice) as sy, covar_pop(l_extendedprice, l_quantity) as xy,
        count(*) as n from lineitem group by all)
    select l_returnflag, l_linestatus, round(sign(xy) * greatest(abs(xy / sx) - 2500.0::double, 0)
      / (1 + 2500.0::double / sy) / sx, 5) + 0.0::double as weight from s where n > 2""")
def m15_penalised(t):
    found = gram.elastic_nets(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice",
                              ["l_quantity"], KEYS, train=None, reg_param=5000.0, elastic_net=0.5)
    return found.filter("n > 2").select("l_returnflag", "l_linestatus",
                                        F.round("weight", 5).alias("weight"))


@query("m16_random_forest")
def m16(t):
    result = regression.random_forest(regression_rows(t), "l_extendedprice", FEATURES, KEYS)
    return result.weights.withColumn("r2", F.lit(result.r2))


def one_hot_sql(column, expression, values):
    return ", ".join(f"({expression} = {v!r})::int::double as \"Field_sourceCol_{column}_value_{v}\""
                     for v in values)


M17_LEVELS = {"NUM_LANES": [1, 2, 3, 4, 5, 6], "FWY_NUM": list(range(25)),
              "FWY_DIR": [0, 1, 2, 3], "DAY_OF_WEEK": [0, 1, 2, 3, 4, 5, 6],
              "DISTRICT_ID": [0, 1, 2, 3, 4]}


@query("m17_regression_features", f"""
    with w as (select 13::double as n, 12::double as n4, avg(i * 0.001::double) as m
               from range(64) r(i)),
    e as (select o_orderkey, o_custkey, o_orderdate, o_totalprice / 1000.0::double as c from orders),
    s as (select c_custkey, c_nationkey, n_regionkey, 32.5E0 + (c_custkey * 37 % 1000) / 1000.0E0
            as lat from customer join nation on n_nationkey = c_nationkey)
    select o_orderkey as "ROW_ID", (o_orderkey % 7 = 0)::int::double as "CHP_INC", lat as "LAT",
      round((c * sqrt(n) + c * 0.5 * sqrt(n) + c * 0.25 * sqrt(n) - c * sqrt(n) + 2.0 * sqrt(n4))
            / 64.0::double + m, 6) as "AGG_TOTAL_FLOW",
      {one_hot_sql('NUM_LANES', '(o_orderkey % 6 + 1)', M17_LEVELS['NUM_LANES'])},
      {one_hot_sql('FWY_NUM', 'c_nationkey', M17_LEVELS['FWY_NUM'])},
      {one_hot_sql('FWY_DIR', '(c_nationkey % 4)', M17_LEVELS['FWY_DIR'])},
      {one_hot_sql('DAY_OF_WEEK', '(isodow(o_orderdate) - 1)', M17_LEVELS['DAY_OF_WEEK'])},
      {one_hot_sql('DISTRICT_ID', 'n_regionkey', M17_LEVELS['DISTRICT_ID'])}
    from e join s on s.c_custkey = e.o_custkey, w""")
def m17(t):
    c = F.col("o_totalprice") / 1000.0
    extract = t.orders.select(
        F.col("o_orderkey").alias("ROW_ID"), F.col("o_custkey").alias("S_ID"),
        (F.col("o_orderkey") % 6 + 1).cast("int").alias("NUM_LANES"),
        F.when(F.col("o_orderkey") % 7 == 0, "T").otherwise("F").alias("CHP_INC"),
        F.date_format("o_orderdate", "MM-dd-yyyy").alias("DATE"), c.alias("Flow_Coef_1"),
        (c * 0.5).alias("Flow_Coef_2"), (c * 0.25).alias("Flow_Coef_3"), (-c).alias("Flow_Coef_4"),
        F.lit(2.0).alias("Flow_Coef_5"), F.lit("x").alias("CHP_DESC"),
        F.lit(1).alias("CHP_DURATION"), F.lit("1179").alias("CC_CODE"))
    districts = t.nation.select("n_nationkey", F.col("n_regionkey").alias("DISTRICT_ID"))
    stations = t.current_station.join(districts, F.col("fwy_id") == F.col("n_nationkey")).select(
        F.col("id").alias("S_ID"), F.col("fwy_id").alias("FWY_NUM"),
        (F.col("fwy_id") % 4).alias("FWY_DIR"), "DISTRICT_ID", F.col("latitude").alias("LAT"))
    rows = regression.prepare(extract, stations, sample_basis(), M17_LEVELS)
    return rows.withColumn("AGG_TOTAL_FLOW", F.round("AGG_TOTAL_FLOW", 6))


@query("m18_coefficient_summary", """
    with w as (select p_brand || '_' || p_type as feature,
                      round(sum((p_size - 25) * p_retailprice), 2) as w from part group by 1)
    select feature, round(abs(w), 2) as size, w < 0 as negative,
           round(abs(w) / max(abs(w)) over (), 9) as normalised from w
    order by abs(w) desc, feature limit 20""")
def m18(t):
    # One row per run and feature, as the regressions of several years give them.
    runs = t.part.select(F.concat_ws("_", "p_brand", "p_type").alias("feature"),
                         ((F.col("p_size") - 25) * F.col("p_retailprice")).alias("weight"))
    summary = regression.coefficient_summary(runs)
    return summary.select("feature", F.round("size", 2).alias("size"), "negative",
                          F.round("normalised", 9).alias("normalised"))


@query("m19_yearly_comparison", """
    with x as (select 2008 + label % 4 as year, case when vec_id % 7 in (0, 6) then 'weekend'
                 else 'weekday' end as part, i, embedding[i + 1]::double as v
               from embeddings, range(64) r(i)),
    g as (select year, part, i, avg(v) as mean, var_samp(v) as variance from x group by 1, 2, 3)
    select year, part, i::int as slot, round(mean, 8) + 0.0::double as mean,
      round(variance / sum(variance) over (partition by year, part), 8) as ratio,
      round(sum(variance) over (partition by year, part order by i)
            / sum(variance) over (partition by year, part), 8) as cumulative from g""")
def m19(t):
    rows = profiles.yearly_summary(coefficient_rows(t))
    return rows.select("year", "part", "slot", *[F.round(c, 8).alias(c) for c in
                                                 ("mean", "ratio", "cumulative")])


@query("m20_eigen_from_accumulator")
def m20(t):
    holes = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when(
        (F.col("vec_id") + i) % 7 == 0, F.lit(float("nan"))).otherwise(v))
    cells = moments.nan_covariance(t.embeddings.select(holes.alias("v")), "v")
    return projection.eigen_from_covariance(cells, t.spark).select("component", "eigenvalue")


@query("m21_pca_cross_check", """
    select c::int as component, true as ratios_agree, true as axes_agree from range(5) r(c)""")
def m21(t):
    rows = vectors_of(t)
    one = projection.fit(rows, "embedding", 5)
    two = projection.fit_from_covariance(rows, "embedding", 5)
    cosines = np.abs((one.components * two.components).sum(axis=1))
    out = [(i, bool(abs(one.ratios[i] - two.ratios[i]) < 1e-9), bool(abs(cosines[i] - 1) < 1e-6))
           for i in range(5)]
    return t.spark.createDataFrame(
        out, "component int, ratios_agree boolean, axes_agree boolean")


@query("m22_detector_interface", """select 'kmeans' as detector, 12::bigint as n""")
def m22(t):
    detector: outliers.Detector = outliers.TrimmedKMeans(["vec_id"], "embedding", 3, 12)
    found = detector.fit(t.embeddings).detect(t.embeddings, 1e-2)
    return found.agg(F.count("*").alias("n")).select(F.lit("kmeans").alias("detector"), "n")


@query("m23_truncation_errors", """
    with cells as (select vec_id, i, i % 10 as c, case when (vec_id + i) % 7 = 0 then 0.0::double
        else embedding[i + 1]::double - i * 0.001::double end as x,
        sqrt(case when i % 10 < 4 then 7 else 6 end::double) as root
      from embeddings, range(64) r(i)),
    coef as (select vec_id, c, sum(x / root) as v from cells group by vec_id, c)
    select cells.vec_id, k::int as k,
      round(avg(power(x - case when cells.c < k then coef.v / root else 0.0::double end, 2)), 9)
        as mse
    from cells join coef using (vec_id, c), (values (2), (4), (6), (8), (10)) ks(k)
    group by 1, 2""")
def m23(t):
    holes = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when(
        (F.col("vec_id") + i) % 7 == 0, F.lit(float("nan"))).otherwise(v))
    rows = t.embeddings.select("vec_id", holes.alias("v"))
    errors = projection.compare_truncations(rows, "v", sample_basis(k=10), ["vec_id"],
                                            [2, 4, 6, 8, 10])
    return errors.withColumn("mse", F.round("mse", 9))


@query("m24_cluster_coefficients")
def m24(t):
    labelled = clustered(t, k=10)
    stats = aggregates.vector_moments(labelled, "c", ["cluster"])
    return aggregates.per_slot(stats, ["cluster"]).select(
        "cluster", F.concat(F.lit("V"), F.col("slot").cast("string")).alias("coefficient"),
        "mean", "std")


@query("m08_single_cluster_cost", """
    with x as (select i, embedding[i + 1]::double as v from embeddings, range(64) r(i))
    select 1 as k, round(sum(s), 6) as cost, round(sqrt(sum(s)), 6) as root
    from (select var_samp(v) * (count(*) - 1) as s from x group by i)""")
def m08_single(t):
    costs = clustering.cost_curve(vectors_of(t), "embedding", most=1)
    return costs.withColumns({c: F.round(c, 6) for c in ("cost", "root")})


@query("m10_outliers_are_the_farthest", """
    select 15::bigint as n, true as beyond_all_others from embeddings limit 1""")
def m10_farthest(t):
    rows = vectors_of(t).select("vec_id", "embedding")
    marked = clustering.kmeans_with_outliers(rows, ["vec_id"], "embedding", 3, 15,
                                             centres=CENTRES)
    edge = marked.agg(
        F.count_if("outlier").alias("n"),
        F.min(F.when(F.col("outlier"), F.col("distance"))).alias("inner"),
        F.max(F.when(~F.col("outlier"), F.col("distance"))).alias("outer"))
    return edge.select("n", (F.col("inner") >= F.col("outer")).alias("beyond_all_others"))


@query("m16_importances_sum_to_one", """
    select count(*) as features, true as sums_to_one from range(3)""")
def m16_sum(t):
    result = regression.random_forest(t.lineitem, "l_extendedprice",
                                      ["l_quantity", "l_discount", "l_tax"], KEYS, trees=5)
    return result.weights.agg(F.count("*").alias("features"),
                              (F.abs(F.sum("weight") - 1) < 1e-9).alias("sums_to_one"))


@query("m20_eigenvalues_sum_to_trace", """
    with x as (select i, embedding[i + 1]::double as v from embeddings, range(64) r(i))
    select round(sum(p), 8) as trace from (select var_pop(v) as p from x group by i)""")
def m20_trace(t):
    cells = moments.nan_covariance(vectors_of(t), "embedding")
    return projection.eigen_from_covariance(cells, t.spark).agg(
        F.round(F.sum("eigenvalue"), 8).alias("trace"))
