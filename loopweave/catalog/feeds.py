"""Streaming operators (X), run to completion over files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.registry import query
from loopweave.session import scratch_path
from loopweave.streaming import feeds

SCHEMA = ("id long, time timestamp_ntz, station_id long, total_flow double, avg_speed double")


def in_three_runs(t, rows, drain):
    """Files arrive a third of the month at a time; each run drains what has come."""
    folder, day = scratch_path(t.spark, "arrivals"), F.dayofmonth("time")
    checkpoint = scratch_path(t.spark, "checkpoint")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        rows.filter(part).write.mode("append").parquet(folder)
        drain(feeds.arriving_files(t.spark, folder, SCHEMA), checkpoint)


def readings(t):
    return t.observation.select("id", "time", "station_id", "total_flow", "avg_speed")


@query("x01_only_new_files", """
    select case when extract(day from time) <= 15 then 1 else 2 end as run, count(*) as n,
           round(sum(total_flow), 2) as flow from observation group by 1""")
def x01(t):
    folder, checkpoint = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "checkpoint")
    out = scratch_path(t.spark, "runs")
    rows, first = readings(t), F.dayofmonth("time") <= 15
    for part in (first, ~first):
        rows.filter(part).write.mode("append").parquet(folder)
        # The same checkpoint: the second run sees only the files that came since.
        feeds.drain_updates(feeds.arriving_files(t.spark, folder, SCHEMA), out, checkpoint)
    return (t.spark.read.parquet(out).groupBy((F.col("batch") + 1).alias("run"))
            .agg(F.count("*").alias("n"), F.round(F.sum("total_flow"), 2).alias("flow")))


@query("x02_tumbling_averages", """
    select date_trunc('hour', time) + interval 1 minute *
        (30 * (extract(minute from time) // 30))::int as window_start,
      station_id, count(*) as n, round(avg(avg_speed), 9) as avg_speed,
      round(avg(total_flow), 9) as total_flow from observation group by 1, 2""")
def x02(t):
    out = scratch_path(t.spark, "windows")
    in_three_runs(t, readings(t), lambda stream, checkpoint: feeds.drain_updates(
        feeds.window_averages(stream), out, checkpoint))
    rows = feeds.latest_updates(t.spark, out, ["window_start", "station_id"])
    return rows.withColumns({c: F.round(c, 9) for c in ("avg_speed", "total_flow")})


@query("x03_drop_duplicate_readings", """
    select station_id, time, any_value(total_flow) as total_flow from observation group by 1, 2""")
def x03(t):
    twice = readings(t).unionByName(readings(t))
    out = scratch_path(t.spark, "distinct")
    in_three_runs(t, twice, lambda stream, checkpoint: feeds.drain(
        feeds.without_duplicates(stream, ["station_id", "time"]), out, checkpoint))
    return t.spark.read.parquet(out).select("station_id", "time", "total_flow")


@query("x04_enriched_stream", """
    select o.id, o.station_id, coalesce(s.id, -1) as station_version
    from (select id, station_id, cast(time as date) - 8760 as day from observation) o
    left join traffic_station s on s.sensor_id = o.station_id and s.eff_start <= o.day
      and (s.eff_end is null or o.day < s.eff_end)""")
def x04(t):
    shifted = readings(t).withColumn("time", F.col("time") - F.expr("interval '8760' day"))
    folder = scratch_path(t.spark, "arrivals")
    shifted.write.parquet(folder)
    stream = feeds.with_station_version(feeds.arriving_files(t.spark, folder, SCHEMA),
                                        t.traffic_station)
    out = scratch_path(t.spark, "enriched")
    feeds.drain(stream, out, scratch_path(t.spark, "checkpoint"))
    return t.spark.read.parquet(out).select("id", "station_id", "station_version")
