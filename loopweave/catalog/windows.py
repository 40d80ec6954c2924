"""Window functions (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopweave.catalog.registry import query
from loopweave.operators import aggregates, clustering, dimensions


@query("w01_effective_end", """
    select sensor_id, eff_start, eff_end from traffic_station""")
def w01(t):
    return dimensions.station_history(t.station_versions, "sensor_id", "eff_start",
                                      tie_break=["num_lanes"]).select("sensor_id", "eff_start",
                                                                      "eff_end")


@query("w02_first_of_sorted_duplicates", """
    select l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey from (
      select *, row_number() over (partition by l_suppkey, l_shipdate
        order by l_orderkey, l_linenumber, l_partkey) as rn from lineitem) where rn = 1""")
def w02(t):
    rows = t.lineitem.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return dimensions.first_per_key(rows, ["l_suppkey", "l_shipdate"],
                                    ["l_orderkey", "l_linenumber", "l_partkey"])


VARIANCES = """select i::int as component, var_samp(embedding[i + 1]::double) as v
               from embeddings, range(64) r(i) group by i"""


@query("w03_cumulative_share", f"""
    with v as ({VARIANCES})
    select component, round(v / sum(v) over (), 9) as ratio,
           round(sum(v) over (order by component) / sum(v) over (), 9) as cumulative from v""")
def w03(t):
    variances = aggregates.per_slot(aggregates.vector_moments(t.embeddings, "embedding"))
    whole = variances.agg(F.sum("variance")).scalar()
    ratios = variances.select(F.col("slot").alias("component"),
                              (F.col("variance") / whole).alias("ratio"))
    shares = aggregates.cumulative_share(ratios, "component", "ratio")
    return shares.select("component", F.round("ratio", 9).alias("ratio"),
                         F.round("cumulative", 9).alias("cumulative"))


@query("w04_consecutive_difference", """
    select year, n, abs(n - lag(n) over (order by year)) as change from (
      select extract(year from o_orderdate)::int as year, count(*) as n from orders group by 1)""")
def w04(t):
    costs = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return clustering.consecutive_change(costs, "year", "n")


@query("w05_dense_surrogate_ids", """
    select part, brand, row_number() over (order by part, brand) as id
    from (select distinct l_partkey as part, l_suppkey as brand from lineitem)""")
def w05(t):
    keys = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("brand"))
    return dimensions.dimension(keys, ["part", "brand"])


@query("w05_ordered_ids", """
    select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) as id
    from orders""")
def w05_ordered(t):
    return dimensions.ordered_ids(t.orders.select("o_custkey", "o_orderkey"),
                                  ["o_custkey", "o_orderkey"])


@query("w06_share_of_total", """
    select fwy_id, n, round(n::double / sum(n) over ()::double, 9) as share from (
      select fwy_id, count(*) as n from incident group by 1)""")
def w06(t):
    counts = t.incident.groupBy("fwy_id").agg(F.count("*").alias("n"))
    # One row per freeway: a window over all of them stays small.
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))
