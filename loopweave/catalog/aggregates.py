"""Aggregations (A), sort and limit (O), set operations (U)."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import functions as F

from loopweave.catalog.registry import query
from loopweave.functions import calendar
from loopweave.operators import aggregates, distinct_sets, moments, reshape, sampling
from loopweave.plans import questions
from loopweave.schemas import PROFILE_KEYS

HALF_HOUR = """date_trunc('hour', time) + interval 1 minute * (30 *
    round_even(extract(minute from time) / 30.0::double, 0))::int"""


def day_quarters(t, keys):
    """Mainline readings on a coarse grid: four slots per day."""
    time = F.col("time")
    return (t.observation.filter(F.col("lane_type") == "ML")
            .select(F.col("station_id"), F.dayofweek(time).alias("day_of_week"),
                    F.to_date(time).alias("day"), time,
                    calendar.day_slot(time, 360).alias("slot"), "total_flow",
                    F.col("avg_occupancy").alias("occupancy"), F.col("avg_speed").alias("speed"))
            .select(*keys, "time", "slot", "total_flow", "occupancy", "speed"))


@query("a01_station_day_profiles", """
    with cells as (select station_id, (dayofweek(time) + 1)::int as day_of_week,
             (extract(hour from time) // 6)::int as slot, max(total_flow) as f,
             max(avg_occupancy) as o, max(avg_speed) as s
           from observation where lane_type = 'ML' group by 1, 2, 3)
    select station_id, day_of_week,
      max(f) filter (slot = 0) as total_flow_0000, max(f) filter (slot = 1) as total_flow_0600,
      max(f) filter (slot = 2) as total_flow_1200, max(f) filter (slot = 3) as total_flow_1800,
      max(o) filter (slot = 0) as occupancy_0000, max(o) filter (slot = 1) as occupancy_0600,
      max(o) filter (slot = 2) as occupancy_1200, max(o) filter (slot = 3) as occupancy_1800,
      max(s) filter (slot = 0) as speed_0000, max(s) filter (slot = 1) as speed_0600,
      max(s) filter (slot = 2) as speed_1200, max(s) filter (slot = 3) as speed_1800
    from cells group by station_id, day_of_week having count(*) = 4""")
def a01(t):
    measures = ["total_flow", "occupancy", "speed"]
    profiles = reshape.slot_profiles(day_quarters(t, ["station_id", "day_of_week"]),
                                     ["station_id", "day_of_week"], "slot", measures, slots=4)
    return reshape.spread_slots(profiles, measures, slots=4)


#: A dense feed derived from the events: every station-day has a value in each of 288
#: slots, made from its readings of the day, but for a gap on every seventh station-day.
DENSE = """days as (select station_id, cast(time as date) as day, sum(total_flow) as f,
      avg(avg_occupancy) as o, avg(avg_speed) as s, min(id) as first from observation
      where lane_type = 'ML' group by 1, 2),
    dense as (select station_id, day, first, slot, f + slot % 17 as total_flow,
        o + slot / 1000.0::double as occupancy, s + slot % 5 as speed
      from days, range(288) r(slot) where not (first % 7 = 0 and slot = first % 288))"""


def dense_feed(t):
    days = (t.observation.filter("lane_type = 'ML'")
            .groupBy("station_id", F.to_date("time").alias("day"))
            .agg(F.sum("total_flow").alias("f"), F.avg("avg_occupancy").alias("o"),
                 F.avg("avg_speed").alias("s"), F.min("id").alias("first")))
    rows = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(287))).alias("slot"))
    rows = rows.filter("not (first % 7 = 0 and slot = first % 288)")
    return rows.select(
        "station_id", F.pmod("station_id", F.lit(12)).cast("int").alias("district_id"),
        F.year("day").alias("year"), F.dayofyear("day").alias("day_of_year"),
        F.dayofweek("day").alias("day_of_week"),
        (F.pmod("station_id", F.lit(4)) + 1).cast("int").alias("direction"), "slot",
        (F.col("f") + F.col("slot") % 17).alias("total_flow"),
        (F.col("o") + F.col("slot") / 1000.0).alias("occupancy"),
        (F.col("s") + F.col("slot") % 5).alias("speed"))


@query("a01_whole_profile_job", f"""
    with {DENSE},
    whole as (select station_id, day from dense group by 1, 2 having count(*) = 288)
    select station_id, (station_id % 12)::int as district_id, extract(year from day)::int as year,
      extract(doy from day)::int as day_of_year, (dayofweek(day) + 1)::int as day_of_week,
      (station_id % 4 + 1)::int as direction, slot::int as slot, round(total_flow, 6) as total_flow,
      round(occupancy, 6) as occupancy, round(speed, 6) as speed
    from dense join whole using (station_id, day)""")
def a01_whole(t):
    """288 slots, three measures, strict, all six keys; one row per cell for the comparison."""
    measures = ["total_flow", "occupancy", "speed"]
    profiles = reshape.slot_profiles(dense_feed(t), PROFILE_KEYS, "slot", measures)
    cells = profiles.select(*PROFILE_KEYS, F.posexplode(F.arrays_zip(*measures)).alias("slot", "v"))
    return cells.select(*PROFILE_KEYS, "slot", *[F.round(f"v.{m}", 6).alias(m) for m in measures])


@query("a01_profiles_lenient", """
    with cells as (select station_id, cast(time as date) as day,
             (extract(hour from time) // 6)::int as slot, max(total_flow) as f
           from observation where lane_type = 'ML' group by 1, 2, 3)
    select station_id, day, coalesce(max(f) filter (slot = 0), 0.0::double) as total_flow_0000,
      coalesce(max(f) filter (slot = 1), 0.0::double) as total_flow_0600,
      coalesce(max(f) filter (slot = 2), 0.0::double) as total_flow_1200,
      coalesce(max(f) filter (slot = 3), 0.0::double) as total_flow_1800
    from cells group by station_id, day""")
def a01_lenient(t):
    profiles = reshape.slot_profiles(day_quarters(t, ["station_id", "day"]), ["station_id", "day"],
                                     "slot", ["total_flow"], slots=4, strict=False)
    return reshape.spread_slots(profiles, ["total_flow"], slots=4)


@query("a01_profiles_five_minute", """
    with cells as (select station_id, cast(time as date) as day,
             ((extract(hour from time) * 60 + extract(minute from time)) // 5)::int as slot,
             min_by(total_flow, time) as f
           from observation where lane_type = 'ML' group by 1, 2, 3)
    select station_id, day, slot, f as total_flow from cells""")
def a01_five(t):
    readings = t.observation.filter(F.col("lane_type") == "ML").select(
        "station_id", F.to_date("time").alias("day"), "time",
        calendar.day_slot(F.col("time"), 5).alias("slot"), "total_flow", F.lit(1.0).alias("seen"))
    # Lenient arrays of the full 288 slots; the second array tells zeros from gaps.
    profiles = reshape.slot_profiles(readings, ["station_id", "day"], "slot",
                                     ["total_flow", "seen"], how="first", time="time",
                                     strict=False)
    cells = F.posexplode(F.arrays_zip("total_flow", "seen")).alias("slot", "v")
    return (profiles.select("station_id", "day", cells).filter(F.col("v.seen") == 1.0)
            .select("station_id", "day", "slot", "v.total_flow"))


@query("a02_mean_pivot", """
    select station_id, avg_flow[1] as total_flow_0000, avg_flow[2] as total_flow_0600,
           avg_flow[3] as total_flow_1200, avg_flow[4] as total_flow_1800 from (
      select station_id, [round(coalesce(avg(total_flow) filter (h = 0), 0.0::double), 9),
          round(coalesce(avg(total_flow) filter (h = 1), 0.0::double), 9),
          round(coalesce(avg(total_flow) filter (h = 2), 0.0::double), 9),
          round(coalesce(avg(total_flow) filter (h = 3), 0.0::double), 9)] as avg_flow
      from (select *, extract(hour from time) // 6 as h from observation where lane_type = 'ML') s
      group by station_id)""")
def a02(t):
    profiles = reshape.slot_profiles(day_quarters(t, ["station_id"]), ["station_id"], "slot",
                                     ["total_flow"], slots=4, how="avg", strict=False)
    wide = reshape.spread_slots(profiles, ["total_flow"], slots=4)
    return wide.select("station_id", *[F.round(c, 9).alias(c) for c in wide.columns[1:]])


@query("a02_five_measure_pivot", """
    with cells as (select station_id, cast(time as date) as day,
             (extract(hour from time) // 6)::int as slot, max(samples)::double as a,
             max(total_flow) as b, max(avg_occupancy) as c, max(avg_speed) as d,
             max(id % 101)::double as e
           from observation where lane_type = 'ML' group by 1, 2, 3)
    select station_id, day, slot, a as samples, e as pct_observed, b as total_flow, c as occupancy,
           d as speed from cells""")
def a02_five(t):
    measures = ["samples", "pct_observed", "total_flow", "occupancy", "speed"]
    time = F.col("time")
    readings = t.observation.filter(F.col("lane_type") == "ML").select(
        "station_id", F.to_date(time).alias("day"), calendar.day_slot(time, 360).alias("slot"),
        "samples", (F.col("id") % 101).alias("pct_observed"), "total_flow",
        F.col("avg_occupancy").alias("occupancy"), F.col("avg_speed").alias("speed"))
    present = readings.withColumn("seen", F.lit(1.0))
    profiles = reshape.slot_profiles(present, ["station_id", "day"], "slot", measures + ["seen"],
                                     slots=4, strict=False)
    zipped = F.arrays_zip(*measures, "seen")
    return (profiles.select("station_id", "day", F.posexplode(zipped).alias("slot", "v"))
            .filter(F.col("v.seen") == 1.0)
            .select("station_id", "day", "slot", *[f"v.{m}" for m in measures]))


@query("a03_mean_coefficient_by_station", """
    select label, (vec_id % 4)::int as direction, i::int as slot,
      round(avg(embedding[i + 1]::double), 8) + 0.0::double as mean
    from embeddings, range(64) r(i) group by 1, 2, 3""")
def a03(t):
    rows = t.embeddings.withColumn("direction", (F.col("vec_id") % 4).cast("int"))
    means = aggregates.vector_moments(rows, "embedding", ["label", "direction"])
    cells = means.select("label", "direction", F.posexplode("mean").alias("slot", "mean"))
    return cells.withColumn("mean", F.round("mean", 8) + F.lit(0.0))


@query("a04_label_fractions", """
    select label, count(*) as n, round(count(*)::double / sum(count(*)) over ()::double, 9)
           as fraction from embeddings group by label""")
def a04(t):
    shares = aggregates.label_shares(t.embeddings, "label")
    return shares.select("label", "n", F.round("fraction", 9).alias("fraction"))


@query("a05_label_vector_moments", """
    with x as (select label, unnest(embedding)::double as v, unnest(range(64))::int as slot
               from embeddings)
    select label, slot, round(avg(v), 8) + 0.0::double as mean,
           round(var_samp(v), 8) as variance from x group by 1, 2""")
def a05(t):
    moments_ = aggregates.vector_moments(t.embeddings, "embedding", ["label"])
    return aggregates.per_slot(moments_, ["label"]).select(
        "label", "slot", F.round("mean", 8).alias("mean"), F.round("variance", 8).alias("variance"))


@query("a06_column_moments", """
    with x as (select unnest(embedding)::double as v, unnest(range(64))::int as slot
               from embeddings)
    select slot, round(avg(v), 8) + 0.0::double as mean, round(var_samp(v), 8) as variance,
           round(stddev_samp(v), 8) as std from x group by 1""")
def a06(t):
    rows = aggregates.per_slot(aggregates.vector_moments(t.embeddings, "embedding"))
    return rows.select("slot", *[F.round(c, 8).alias(c) for c in ("mean", "variance", "std")])


@query("a07_daily_profile_band", """
    with x as (select extract(hour from time)::int as hour, total_flow as v, lane_type
               from observation)
    select lane_type, hour, round(avg(v), 9) as mean, round(stddev_samp(v), 9) as std,
           round(avg(v) - stddev_samp(v), 9) as lower, round(avg(v) + stddev_samp(v), 9) as upper
    from x group by 1, 2""")
def a07(t):
    mean, std = F.avg("total_flow"), F.stddev_samp("total_flow")
    return (t.observation.groupBy("lane_type", F.hour("time").alias("hour"))
            .agg(F.round(mean, 9).alias("mean"), F.round(std, 9).alias("std"),
                 F.round(mean - std, 9).alias("lower"), F.round(mean + std, 9).alias("upper")))


@query("a08_slow_half_hours", f"""
    select station_id, {HALF_HOUR} as bucket, round(avg(avg_speed), 9) as bucket_avg
    from observation group by 1, 2 having avg(avg_speed) < 1.5::double""")
def a08(t):
    buckets = aggregates.bucket_averages(t.observation, 30)
    return (buckets.filter(F.col("bucket_avg") < 1.5)
            .select("station_id", "bucket", F.round("bucket_avg", 9).alias("bucket_avg"))
            .orderBy("bucket", "station_id"))


@query("a09_station_day_average", """
    select station_id, cast(time as date) as day, round(avg(avg_speed), 9) as day_avg
    from observation group by 1, 2""")
def a09(t):
    return aggregates.day_averages(t.observation).withColumn("day_avg", F.round("day_avg", 9))


@query("a10_station_week_averages", """
    select s.id as station_id, s.name,
      round(avg(avg_speed) filter (time <= timestamp '2024-01-07 23:59:59'), 9) as week_one,
      round(avg(avg_speed) filter (time >= timestamp '2024-01-08 00:00:00'), 9) as week_two
    from observation o join current_station s on s.id = o.station_id
    where time between timestamp '2024-01-01 00:00:00' and timestamp '2024-01-07 23:59:59'
       or time between timestamp '2024-01-08 00:00:00' and timestamp '2024-01-14 23:59:59'
    group by 1, 2
    having avg(avg_speed) filter (time <= timestamp '2024-01-07 23:59:59') > 0
       and avg(avg_speed) filter (time >= timestamp '2024-01-08 00:00:00') > 0""")
def a10(t):
    weeks = questions.week_averages(t.observation, t.current_station, "2024-01-01", "2024-01-08")
    return weeks.select("station_id", "name", F.round("week_one", 9).alias("week_one"),
                        F.round("week_two", 9).alias("week_two"))


@query("a11_freeway_hour_speed", """
    select f.num, f.direction, round(avg(o.avg_speed), 9) as avg_speed
    from observation o, current_station s, freeways f
    where s.id = o.station_id and s.fwy_id = f.id
      and extract(hour from o.time) between 15 and 19 and o.avg_speed > 0
    group by f.num, f.direction""")
def a11(t):
    speeds = questions.freeway_speeds(t.observation, t.current_station, t.freeways, (15, 19))
    return speeds.select("num", "direction", F.round("avg_speed", 9).alias("avg_speed"))


@query("a12_average_on_dates", """
    select round(avg(total_flow), 9) as avg_flow, count(*) as n from observation
    where cast(time as date) in (date '2024-01-01', date '2024-01-08')""")
def a12(t):
    days = [F.lit(d).cast("date") for d in ("2024-01-01", "2024-01-08")]
    return (t.observation.filter(F.to_date("time").isin(*days))
            .agg(F.round(F.avg("total_flow"), 9).alias("avg_flow"), F.count("*").alias("n")))


@query("a13_incidents_per_day", """
    select cast(time as date) as day, count(*) as n from incident group by 1""")
def a13(t):
    return t.incident.groupBy(F.to_date("time").alias("day")).agg(F.count("*").alias("n"))


@query("a14_distinct_subset", """
    select distinct fwy_id, type_id, num_lanes from station_versions""")
def a14(t):
    return t.station_versions.select("fwy_id", "type_id", "num_lanes").distinct()


@query("a15_most_common_tuple", """
    select station_id, lane_type, samples, n from (
      select station_id, lane_type, samples, count(*) as n, row_number() over (
        partition by station_id order by count(*) desc, lane_type, samples) as rn
      from observation group by 1, 2, 3) where rn = 1""")
def a15(t):
    return aggregates.most_common(t.observation, ["station_id"], ["lane_type", "samples"])


@query("a16_weather_station_rollup", """
    with m as (select fwy_id, substr(name, 18, 1) as tag, latitude, longitude, elevation
               from weather_station),
    names as (select fwy_id, tag, row_number() over (partition by fwy_id
                order by count(*) desc, tag) as rn from m group by fwy_id, tag)
    select m.fwy_id, any_value(names.tag) as name, round(avg(latitude), 9) as latitude,
           round(avg(longitude), 9) as longitude, round(avg(elevation), 4) as elevation
    from m join names on names.fwy_id = m.fwy_id and names.rn = 1 group by m.fwy_id""")
def a16(t):
    rows = t.weather_station.withColumn("name", F.substring("name", 18, 1))
    names = aggregates.most_common(rows, ["fwy_id"], ["name"]).drop("n")
    means = rows.groupBy("fwy_id").agg(
        F.round(F.avg("latitude"), 9).alias("latitude"),
        F.round(F.avg("longitude"), 9).alias("longitude"),
        F.round(F.avg("elevation"), 4).alias("elevation"))
    return means.join(names, "fwy_id")


@query("a17_row_counts", """
    select 'district' as table_name, count(*) as n from district
    union all select 'freeways', count(*) from freeways
    union all select 'traffic_station', count(*) from traffic_station
    union all select 'observation', count(*) from observation
    union all select 'lane_observation', count(*) from lane_observation
    union all select 'incident', count(*) from incident
    union all select 'weather_station', count(*) from weather_station
    union all select 'precipitation_daily_total', count(*) from precipitation_daily_total""")
def a17(t):
    names = ["district", "freeways", "traffic_station", "observation", "lane_observation",
             "incident", "weather_station", "precipitation_daily_total"]
    return reduce(lambda a, b: a.unionByName(b), [
        getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
        for n in names])


NAN_VECTORS = """
    holes as (select vec_id, i, case when (vec_id + i) % 7 = 0 then null
                     else embedding[i + 1]::double end as v
              from embeddings, range(64) r(i))"""


@query("a18_nan_aware_covariance", f"""
    with {NAN_VECTORS}, m as (select i, avg(v) as mean from holes group by i)
    select a.i::int as i, b.i::int as j, count(*) as n,
           round(avg(a.v * b.v) - any_value(ma.mean) * any_value(mb.mean), 9) + 0.0::double
             as covariance
    from holes a join holes b on a.vec_id = b.vec_id and a.i <= b.i
      join m ma on ma.i = a.i join m mb on mb.i = b.i
    where a.v is not null and b.v is not null group by a.i, b.i""")
def a18(t):
    holes = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when(
        (F.col("vec_id") + i) % 7 == 0, F.lit(float("nan"))).otherwise(v))
    cells = moments.nan_covariance(t.embeddings.select(holes.alias("v")), "v")
    return cells.select("i", "j", "n", F.round("covariance", 9).alias("covariance"))


@query("a18_nan_aware_mean", f"""
    with {NAN_VECTORS} select i::int as i, count(v) as n, round(avg(v), 9) + 0.0::double as mean
    from holes group by i""")
def a18_mean(t):
    holes = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when(
        (F.col("vec_id") + i) % 7 == 0, F.lit(float("nan"))).otherwise(v))
    means = moments.nan_mean(t.embeddings.select(holes.alias("v")), "v")
    return means.select("i", "n", F.round("mean", 9).alias("mean"))


@query("a19_sample_covariance", """
    with x as (select vec_id, i, embedding[i + 1]::double as v from embeddings, range(64) r(i))
    select a.i::int as i, b.i::int as j, round(covar_samp(a.v, b.v), 9) + 0.0::double as covariance
    from x a join x b on a.vec_id = b.vec_id and a.i <= b.i group by a.i, b.i""")
def a19(t):
    cells = moments.sample_covariance(t.embeddings, "embedding")
    return cells.select("i", "j", F.round("covariance", 9).alias("covariance"))


@query("a20_sum_weights_per_feature", """
    select l_returnflag || '_' || l_linestatus as feature, round(sum(l_discount), 4) as weight
    from lineitem group by 1""")
def a20(t):
    return (t.lineitem.groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("feature"))
            .agg(F.round(F.sum("l_discount"), 4).alias("weight")))


@query("a21_coefficient_ranges", """
    select i::int as coefficient, min(embedding[i + 1])::double as low,
           max(embedding[i + 1])::double as high from embeddings, range(64) r(i) group by i""")
def a21(t):
    x = F.col("embedding").cast("array<double>")
    ranges = t.embeddings.agg(*[f for i in range(64) for f in (
        F.min(x[i]).alias(f"low_{i}"), F.max(x[i]).alias(f"high_{i}"))])
    rows = F.array(*[F.struct(F.lit(i).alias("coefficient"), F.col(f"low_{i}").alias("low"),
                              F.col(f"high_{i}").alias("high")) for i in range(64)])
    return ranges.select(F.inline(rows))


@query("a22_district_histogram", """
    select n_regionkey as district_id, (c_acctbal >= 5000) as member, count(*) as n
    from customer join nation on n_nationkey = c_nationkey group by 1, 2""")
def a22(t):
    districts = t.nation.select(F.col("n_nationkey").alias("c_nationkey"),
                                F.col("n_regionkey").alias("district_id"))
    # Counted per nation before the join, so the join sees one row per nation and side.
    return (t.customer.groupBy("c_nationkey", (F.col("c_acctbal") >= 5000).alias("member"))
            .agg(F.count("*").alias("n")).join(districts, "c_nationkey")
            .groupBy("district_id", "member").agg(F.sum("n").alias("n")))


@query("a23_histogram_2d", """
    with x as (select l_quantity as x, l_extendedprice as y from lineitem),
    e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from x)
    select least(99, floor((x - x0) / (x1 - x0) * 100))::int as bin_x,
           least(99, floor((y - y0) / (y1 - y0) * 100))::int as bin_y, count(*) as n
    from x, e group by 1, 2""")
def a23(t):
    return aggregates.histogram_2d(t.lineitem, "l_quantity", "l_extendedprice", 100)


@query("a24_scalar_statistics", """
    select count(*) as n, round(avg(value), 9) as mean, round(var_pop(value), 9) as variance,
           round(stddev_pop(value), 9) as std from events""")
def a24(t):
    return t.events.agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"),
                        F.round(F.var_pop("value"), 9).alias("variance"),
                        F.round(F.stddev_pop("value"), 9).alias("std"))


@query("a25_fraction_sample", """
    select id, station_id from observation
    where substr(md5('47|' || cast(id as varchar)), 1, 8) < '0ccccccc'""")
def a25(t):
    return sampling.hash_fraction(t.observation.select("id", "station_id"), ["id"], 0.05, "47")


@query("a25_ten_rows_sample", """
    select id, station_id from observation order by md5('47|' || cast(id as varchar)), id limit 10
    """)
def a25_ten(t):
    return sampling.hash_first(t.observation.select("id", "station_id"), ["id"], 10, "47")


@query("a26_stations_per_district_sample", """
    with s as (select c.id, f.district_id, row_number() over (partition by f.district_id
                 order by md5('|' || cast(c.id as varchar)), c.id) as r,
                 count(*) over (partition by f.district_id) as n
               from current_station c join freeways f on f.id = c.fwy_id)
    select id, district_id, r as sample_rank, r <= 3 as chosen from s
    where r <= ceil(n * 0.05::double)""")
def a26(t):
    stations = t.current_station.select("id", "fwy_id").join(
        t.freeways.select(F.col("id").alias("fwy_id"), "district_id"), "fwy_id")
    sample = sampling.share_per_group(stations.select("id", "district_id"), "district_id", ["id"],
                                      0.05)
    return sample.withColumn("chosen", F.col("sample_rank") <= 3)


@query("a27_bucket_below_day_share", f"""
    with b as (select station_id, {HALF_HOUR} as bucket, avg(avg_speed) as a
               from observation group by 1, 2),
    d as (select station_id, cast(time as date) as day, avg(avg_speed) as a
          from observation group by 1, 2)
    select b.station_id, b.bucket, round(b.a, 9) as bucket_avg, round(d.a, 9) as day_avg
    from b join d on d.station_id = b.station_id and d.day = cast(b.bucket as date)
    where b.a < 0.4::double * d.a""")
def a27(t):
    dips = aggregates.dips_below_day(t.observation, 30)
    return dips.select("station_id", "bucket", F.round("bucket_avg", 9).alias("bucket_avg"),
                       F.round("day_avg", 9).alias("day_avg"))


RAIN_SQL = """
    with days as (select unnest(range(date '1996-01-01', date '1996-12-31', interval 7 day))::date
                  as day),
    rainy as (select distinct p.day from precipitation_daily_total p join days using (day)
              where p.amount > {least}::double {near}),
    obs as (select cast(time as date) as day, duration::double as flow from incident
            where cast(time as date) in (select day from days))
    select round(avg(flow) filter (rainy.day is not null), 9) as rainy_avg,
           round(avg(flow) filter (rainy.day is null), 9) as dry_avg,
           count(distinct obs.day) filter (rainy.day is not null) as rainy_days,
           count(distinct obs.day) filter (rainy.day is null) as dry_days,
           round((avg(flow) filter (rainy.day is null) - avg(flow) filter (rainy.day is not null))
                 * 288.0::double, 4) as delta_per_day
    from obs left join rainy on rainy.day = obs.day"""
MONDAYS = [str(date(1996, 1, 1) + timedelta(7 * i)) for i in range(53)]


def rounded_comparison(result):
    return result.select(F.round("rainy_avg", 9).alias("rainy_avg"),
                         F.round("dry_avg", 9).alias("dry_avg"), "rainy_days", "dry_days",
                         F.round("delta_per_day", 4).alias("delta_per_day"))


@query("a28_rainy_dry_comparison", RAIN_SQL.format(
    least=0.02, near="and p.station_id in (select id from weather_station where elevation < 200)"))
def a28(t):
    rain = t.precipitation_daily_total.withColumn("amount", F.col("amount") - 0.02)
    return rounded_comparison(aggregates.rain_comparison(
        t.incident, rain, t.weather_station.filter(F.col("elevation") < 200), MONDAYS, "duration"))


@query("o01_multi_key_sort", """
    select fwy_id, type_id, sensor_id, eff_start from traffic_station
    order by fwy_id, type_id, sensor_id, eff_start""")
def o01(t):
    return (t.traffic_station.select("fwy_id", "type_id", "sensor_id", "eff_start")
            .orderBy("fwy_id", "type_id", "sensor_id", "eff_start"))


TOP_FIVE = """select num, direction, round(s, 9) as avg_speed, '{kind}' as kind from (
    select f.num, f.direction, avg(o.avg_speed) as s
    from observation o, current_station c, freeways f
    where c.id = o.station_id and c.fwy_id = f.id and o.avg_speed > 0
    group by f.num, f.direction order by s {way}, num limit 5)"""


@query("o02_top_and_bottom_five",
       TOP_FIVE.format(kind="fastest", way="desc") + " union all "
       + TOP_FIVE.format(kind="slowest", way="asc"))
def o02(t):
    speeds = questions.freeway_speeds(t.observation, t.current_station, t.freeways)
    best = speeds.orderBy(F.desc("avg_speed"), "num").limit(5).withColumn("kind", F.lit("fastest"))
    worst = speeds.orderBy("avg_speed", "num").limit(5).withColumn("kind", F.lit("slowest"))
    return (best.unionByName(worst)
            .select("num", "direction", F.round("avg_speed", 9).alias("avg_speed"), "kind"))


@query("o03_largest_by_distance", """
    select vec_id, round(d, 9) as distance from (
      select vec_id, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as d
      from embeddings) order by d desc, vec_id limit 20""")
def o03(t):
    squared = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0),
                          lambda acc, x: acc + x * x)
    return (t.embeddings.select("vec_id", squared.alias("distance"))
            .orderBy(F.desc("distance"), "vec_id").limit(20)
            .select("vec_id", F.round("distance", 9).alias("distance")))


@query("o04_single_top_row", """
    select id, station_id, total_flow from observation order by total_flow desc, id limit 1""")
def o04(t):
    top = F.max_by(F.struct("id", "station_id", "total_flow"),
                   F.struct("total_flow", (-F.col("id")).alias("_minus")))
    return t.observation.agg(top.alias("r")).select("r.*")


@query("o05_top_twenty_features", """
    select feature, round(w, 4) as weight from (
      select p_brand || '_' || p_type as feature, sum(p_retailprice) as w from part group by 1)
    order by w desc, feature limit 20""")
def o05(t):
    weights = (t.part.groupBy(F.concat_ws("_", "p_brand", "p_type").alias("feature"))
               .agg(F.sum("p_retailprice").alias("weight")))
    return (weights.orderBy(F.desc("weight"), "feature").limit(20)
            .select("feature", F.round("weight", 4).alias("weight")))


@query("o06_plain_limit")
def o06(t):
    return t.observation.limit(10)


@query("u01_union_of_files", """
    select id, time, 'observation' as feed from observation
    union all select id, time, 'incident' from incident""")
def u01(t):
    return (t.observation.select("id", "time", F.lit("observation").alias("feed"))
            .unionByName(t.incident.select("id", "time", F.lit("incident").alias("feed"))))


@query("u02_set_difference", """
    select station_id, cast(time as date) as day from observation
    except select station_id, cast(time as date) from observation where total_flow > 60""")
def u02(t):
    days = t.observation.select("station_id", F.to_date("time").alias("day")).distinct()
    busy = (t.observation.filter(F.col("total_flow") > 60)
            .select("station_id", F.to_date("time").alias("day")))
    return days.join(busy, ["station_id", "day"], "left_anti")


@query("u03_fan_out", """
    select 'valid' as branch, count(*) as n, round(sum(total_flow), 2) as flow from observation
      where samples > 0
    union all select 'idle', count(*), round(sum(total_flow), 2) from observation
      where samples = 0""")
def u03(t):
    # Two consumers of one feed become one pass with a branch column.
    branch = F.when(F.col("samples") > 0, "valid").otherwise("idle")
    return (t.observation.groupBy(branch.alias("branch"))
            .agg(F.count("*").alias("n"), F.round(F.sum("total_flow"), 2).alias("flow")))


DAY_PART = """case when dayofweek(time) in (0, 6) then 'weekend' else 'weekday' end"""


@query("u04_sorted_distinct_list", f"""
    with s as (select distinct extract(year from time)::int as year, {DAY_PART} as part, id
               from (select time, id from incident union all
                     select time, station_id from observation))
    select year, part, (case when id > 0 then (id - 1) // 32768 + 1 else id // 32768 end)::bigint as page,
      row_number() over (partition by year, part, page order by id)::int as place, id from s""")
def u04(t):
    """The list itself, in pages of at most 32,768 ids."""
    both = t.incident.select("time", F.col("id").cast("long")).unionByName(
        t.observation.select("time", F.col("station_id").cast("long").alias("id")))
    part = F.when(calendar.is_weekend(F.col("time")), "weekend").otherwise("weekday")
    rows = both.select(F.year("time").alias("year"), part.alias("part"), "id")
    pages = distinct_sets.pages(distinct_sets.id_sets(rows, ["year", "part"], "id"))
    return pages.select("year", "part", "page", F.posexplode("ids").alias("place", "id")).withColumn(
        "place", F.col("place") + 1)


@query("u04_merged_distinct_counts", f"""
    select {DAY_PART} as part, count(distinct id) as n
    from (select time, id from incident union all select time, station_id from observation)
    group by 1""")
def u04_merged(t):
    """Sets of years and sources, made apart, merge into one for each part of the week."""
    part = F.when(calendar.is_weekend(F.col("time")), "weekend").otherwise("weekday")
    made = [distinct_sets.id_sets(df.select(F.year("time").alias("year"), part.alias("part"), c),
                                  ["year", "part"], c)
            for df, c in ((t.incident, "id"), (t.observation, "station_id"))]
    sets = distinct_sets.merged(made[0].unionByName(made[1]), ["part"])
    return distinct_sets.counts(sets, ["part"])
