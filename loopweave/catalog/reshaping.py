"""Reshape and array operators (R)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loopweave.catalog.reading import raw_feed
from loopweave.catalog.registry import query
from loopweave.operators import projection, reshape
from loopweave.sources import readers


@query("r01_unpivot_months", """
    select zip, date '2008-01-01' as month, m2008_01 as value from home_value
    union all select zip, date '2008-02-01', m2008_02 from home_value""")
def r01(t):
    return reshape.unpivot_months(t.home_value, "zip")


@query("r02_one_hot", """
    select l_orderkey, l_linenumber, (l_returnflag = 'A')::int::double
        as "Field_sourceCol_l_returnflag_value_A",
      (l_returnflag = 'N')::int::double as "Field_sourceCol_l_returnflag_value_N",
      (l_returnflag = 'R')::int::double as "Field_sourceCol_l_returnflag_value_R" from lineitem""")
def r02(t):
    return reshape.one_hot(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"),
                           "l_returnflag")


@query("r03_station_time_matrix", """
    with x as (select o.station_id, extract(day from o.time)::int - 1 as j, avg(o.total_flow) as v
      from observation o join current_station s on s.id = o.station_id
      where s.fwy_id = 5 group by 1, 2),
    st as (select distinct station_id from x)
    select st.station_id as i, d.j::int as j, round(coalesce(x.v, 0.0::double), 9) as value
    from st, range(31) d(j) left join x on x.station_id = st.station_id and x.j = d.j""")
def r03(t):
    members = t.current_station.filter(F.col("fwy_id") == 5).select(F.col("id").alias("station_id"))
    readings = (t.observation.join(members, "station_id", "left_semi")
                .withColumn("slot", F.dayofmonth("time") - 1))
    rows = reshape.slot_profiles(readings, ["station_id"], "slot", ["total_flow"], slots=31,
                                 how="avg", strict=False)
    return reshape.as_cells(rows, "station_id", "total_flow").withColumn(
        "value", F.round("value", 9))


@query("r04_lane_group_to_rows", """
    select station_id as station, lane, count(*) as n, sum(id % 50 + lane)::bigint as flow
    from (select *, unnest(range((id % 3 + 1)::int))::int as lane from observation)
    group by 1, 2""")
def r04(t):
    lanes = readers.split_station_feed(t.spark, raw_feed(t))["lane"]
    return lanes.groupBy("station", "lane").agg(F.count("*").alias("n"),
                                                F.sum("flow").alias("flow"))


def sample_basis(n=64, k=5):
    """A simple orthonormal basis that SQL can state: component c covers slots c, c + k, ..."""
    slots = np.arange(n)
    axes = np.array([(slots % k == c) / np.sqrt((slots % k == c).sum()) for c in range(k)])
    return projection.Basis(slots * 0.001, axes, np.full(k, 1.0 / k))


@query("r05_mean_of_reconstruction", """
    select vec_id, round(list_sum(list_transform(embedding, lambda v: v::double)) / 64.0::double
      + (select avg(i * 0.001::double) from range(64) r(i)), 8) + 0.0::double as agg_total_flow
    from embeddings""")
def r05(t):
    # As many components as entries: each one stands for a slot.
    coefficients = F.col("embedding").cast("array<double>")
    value = projection.mean_of_reconstruction(coefficients, sample_basis(k=64))
    return t.embeddings.select("vec_id", (F.round(value, 8) + F.lit(0.0)).alias("agg_total_flow"))


@query("r06_transposed_cells", """
    select i::int as i, vec_id as j, embedding[i + 1]::double as value
    from embeddings, range(64) r(i)""")
def r06(t):
    cells = reshape.as_cells(t.embeddings.withColumn(
        "embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding")
    return reshape.transpose_cells(cells)


@query("r07_coefficient_columns", """
    with x as (select vec_id, date '2008-01-01' + (vec_id % 366)::int as day,
                      i::int as slot, embedding[i + 1]::double as v
               from embeddings, range(64) r(i))
    select vec_id, day, slot, v as flow, case when dayofweek(day) not in (0, 6) then v end
      as weekday, case when dayofweek(day) in (0, 6) then v end as weekend
    from x""")
def r07(t):
    x = F.col("embedding").cast("array<double>")
    projected = t.embeddings.select(
        "vec_id", F.date_add(F.lit("2008-01-01").cast("date"), (F.col("vec_id") % 366).cast("int"))
        .alias("day"), *[x[i].alias(f"V{i}") for i in range(64)])
    rows = reshape.coefficient_columns(projected, 64, F.col("day"))
    cells = rows.select("vec_id", "day", "weekday_coef", "weekend_coef",
                        F.posexplode("flow_coef").alias("slot", "flow"))
    return cells.select("vec_id", "day", "slot", "flow",
                        F.get("weekday_coef", F.col("slot")).alias("weekday"),
                        F.get("weekend_coef", F.col("slot")).alias("weekend"))
