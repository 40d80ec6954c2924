"""Named questions and loads (N)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loopweave.catalog.aggregates import (HALF_HOUR, MONDAYS, RAIN_SQL, rounded_comparison)
from loopweave.catalog.joins import DIPS, DISTANCE, QUARTER_HOUR
from loopweave.catalog.reading import (coefficient_rows, raw_feed, raw_home_values, raw_incidents,
                                       raw_precipitation_lines, raw_station_meta)
from loopweave.catalog.registry import query
from loopweave.functions.sql import register_functions, register_views
from loopweave.operators import dimensions, projection, reshape, spatial
from loopweave.plans import loads, profiles, questions, star
from loopweave.session import scratch_path, staged
from loopweave.sources import readers, writers


@query("n01_largest_speed_change", """
    select s.id as station_id, s.name, round(w1.a, 9) as week_one, round(w2.a, 9) as week_two,
      round(w2.a - w1.a, 9) as delta from
      (select station_id, avg(avg_speed) as a from observation where time between
        timestamp '2024-01-01 00:00:00' and timestamp '2024-01-07 23:59:59'
        group by 1 having avg(avg_speed) > 0) w1
      join (select station_id, avg(avg_speed) as a from observation where time between
        timestamp '2024-01-08 00:00:00' and timestamp '2024-01-14 23:59:59'
        group by 1 having avg(avg_speed) > 0) w2 on w1.station_id = w2.station_id
      join current_station s on s.id = w1.station_id
    order by w2.a - w1.a desc, s.id limit 1""")
def n01(t):
    row = questions.largest_speed_change(t.observation, t.current_station, "2024-01-01",
                                         "2024-01-08")
    return row.withColumns({c: F.round(c, 9) for c in ("week_one", "week_two", "delta")})


@query("n02_rainy_monday_throughput", RAIN_SQL.format(least=0.13, near="""and p.station_id in (
    select id from weather_station where 2 * 6371008.8::double * asin(sqrt(least(1.0::double,
        power(sin(radians(latitude - 32.711404::double) / 2), 2)
        + cos(radians(32.711404::double)) * cos(radians(latitude))
        * power(sin(radians(longitude + 117.168347::double) / 2), 2)))) < 15 * 1852)"""))
def n02(t):
    rain = t.precipitation_daily_total.withColumn("amount", F.col("amount") - 0.13)
    return rounded_comparison(questions.rainy_day_throughput(
        t.incident, rain, t.weather_station, MONDAYS, 32.711404, -117.168347, 15, "duration"))


WEEKS = [("1996-01-01", "1996-01-05 23:59:59"), ("1996-01-08", "1996-01-12 23:59:59"),
         ("1996-01-15", "1996-01-19 23:59:59")]
N03 = """select case when time < timestamp '1996-01-06' then 1 when time < timestamp '1996-01-13'
      then 2 else 3 end as week, cast(time as date) as day, count(*) as n from incident
    where (time between timestamp '1996-01-01' and timestamp '1996-01-05 23:59:59'
      or time between timestamp '1996-01-08' and timestamp '1996-01-12 23:59:59'
      or time between timestamp '1996-01-15' and timestamp '1996-01-19 23:59:59') {kind}
    group by 1, 2"""


@query("n03_incidents_per_weekday", N03.format(kind=""))
def n03(t):
    return questions.incidents_per_day(t.incident, WEEKS)


@query("n03_collisions_per_weekday", N03.format(
    kind="and (description like '1179-%' or description like '1183-%')"))
def n03_collisions(t):
    return questions.incidents_per_day(t.incident, WEEKS, ["1179", "1183"])


N04 = """select num, direction, round(s, 9) as avg_speed, '{kind}' as kind from (
    select f.num, f.direction, avg(o.avg_speed) as s
    from observation o, current_station c, freeways f
    where c.id = o.station_id and c.fwy_id = f.id
      and o.time between timestamp '2024-01-01' and timestamp '2024-01-08'
      and extract(hour from o.time) between 15 and 19 and o.avg_speed > 0
    group by f.num, f.direction order by s {way}, num limit 5)"""


@query("n04_fastest_and_slowest_freeways", N04.format(kind="fastest", way="desc") + " union all "
       + N04.format(kind="slowest", way="asc"))
def n04(t):
    rows = questions.fastest_and_slowest(t.observation, t.current_station, t.freeways, (15, 19),
                                         ("2024-01-01", "2024-01-08"))
    return rows.withColumn("avg_speed", F.round("avg_speed", 9))


@query("n05_one_district_explains_others")
def n05(t):
    stations = t.current_station.join(
        t.freeways.select(F.col("id").alias("fwy_id"), "district_id"), "fwy_id")
    readings = (t.observation.join(stations.select(F.col("id").alias("station_id"), "district_id"),
                                   "station_id").withColumn("slot", F.dayofmonth("time") - 1))
    # One profile for a station and month: a slot is a day, so no two months are mixed.
    rows = staged(reshape.slot_profiles(
        readings.withColumn("month", F.trunc("time", "month")),
        ["station_id", "district_id", "month"], "slot", ["total_flow"], slots=31, how="avg",
        strict=False), "profiles")
    return projection.explain_others(rows, "total_flow", "district_id", 0, 2)


@query("n06_slow_intervals", f"""
    select s.name, s.latitude, b.bucket, round(b.f, 9) as avg_flow, round(b.v, 9) as avg_speed
    from (select station_id, {HALF_HOUR} as bucket, avg(total_flow) as f, avg(avg_speed) as v
          from observation where time between timestamp '2024-01-10' and timestamp '2024-01-20'
          group by 1, 2 having avg(avg_speed) < 4.5::double) b
    join current_station s on s.id = b.station_id join freeways f on f.id = s.fwy_id
    join st_type t on t.id = s.type_id
    where f.num = 13 and f.direction = 'E' and t.type = 'ML'""")
def n06(t):
    rows = questions.slow_intervals(t.observation, t.current_station, t.freeways, t.st_type, 13, "E",
                                    ("2024-01-10", "2024-01-20"), 4.5)
    return rows.withColumns({c: F.round(c, 9) for c in ("avg_flow", "avg_speed")})


@query("n07_freeway_dips", f"""
    with {DIPS.format(bucket=HALF_HOUR, where='')}
    select distinct f.num, f.direction, dips.bucket from dips
    join current_station s on s.id = dips.station_id join freeways f on f.id = s.fwy_id""")
def n07(t):
    return questions.freeway_dips(t.observation, t.current_station, t.freeways)


SIMILAR = f"""
    with {DIPS.format(bucket=QUARTER_HOUR, where='where samples <> 0')},
    f as (select dips.*, fr.num, fr.direction from dips join current_station s
            on s.id = dips.station_id {{kind}} join freeways fr on fr.id = s.fwy_id {{nums}})
    select distinct a.num as num_1, a.direction as direction_1, b.num as num_2,
           b.direction as direction_2
    from f a join f b on a.bucket = b.bucket
      and b.bucket_avg between a.bucket_avg * 0.9::double and a.bucket_avg * 1.1::double"""


@query("n08_similar_freeways", SIMILAR.format(kind="", nums=""))
def n08(t):
    return questions.similar_freeways(t.observation, t.current_station, t.freeways)


@query("n08_similar_selected_freeways", SIMILAR.format(kind="and s.type_id = 6",
                                                       nums="and fr.num in (5, 8, 12)"))
def n08_selected(t):
    return questions.similar_freeways(t.observation, t.current_station, t.freeways, [5, 8, 12],
                                      type_id=6)


@query("n09_regression_extract", f"""
    with homes as (select zip, date '1996-01-01' + interval 1 month * (zip % 60)::int as month,
                          m2008_01 as avg_value from home_value),
    rows as (select s.id, s.num_lanes, s.fwy_id, s.latitude, s.longitude, s.eff_start as date,
                    (s.sensor_id % 200)::bigint as zip
             from traffic_station s join st_type t on t.id = s.type_id and t.type = 'ML')
    select r.id as s_id, r.num_lanes, r.date, f.num as fwy_num, case f.direction when 'N' then 0
        when 'E' then 1 when 'S' then 2 else 3 end as fwy_dir, h.avg_value,
      case when c.id is null then 'F' else 'T' end as chp_inc,
      case when strpos(c.description, '-') > 0 then split_part(c.description, '-', 1)
        when c.id is not null then '1' end as cc_code, c.duration as chp_duration
    from rows r join freeways f on f.id = r.fwy_id
    join homes h on h.zip = r.zip and h.month = date_trunc('month', r.date)
    left join incident c on cast(c.time as date) = r.date and c.fwy_id = r.fwy_id
      and {DISTANCE.format(a='r', b='c')} < 40000""")
def n09(t):
    station_days = t.traffic_station.select("id", F.col("eff_start").alias("date"))
    sites = t.traffic_station.select("id", "num_lanes", "fwy_id", "type_id", "latitude",
                                     "longitude", (F.col("sensor_id") % 200).alias("zip"))
    homes = t.home_value.select(
        "zip", F.add_months(F.lit("1996-01-01").cast("date"), (F.col("zip") % 60).cast("int"))
        .alias("month"), F.col("m2008_01").alias("avg_value"))
    extract = loads.regression_extract(station_days, sites, t.st_type, t.freeways, homes,
                                       t.incident, metres=40000)
    return extract.select("s_id", "num_lanes", "date", "fwy_num", "fwy_dir", "avg_value",
                          "chp_inc", "cc_code", "chp_duration")


@query("n10_missing_coefficients", """
    select count(*) as n from orders where dayofweek(o_orderdate) not in (0, 6)
      and o_orderkey % 3 = 0""")
def n10(t):
    rows = t.orders.select(
        F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"),
        F.when(F.col("o_orderkey") % 3 != 0, F.array("o_totalprice")).alias("weekday_coef"))
    return questions.missing_coefficients(rows, "year", "doy", "weekday_coef")


@query("n11_incident_points", """
    select c.id, c.latitude, c.longitude, c.time, c.description, f.num, f.direction
    from incident c join freeways f on f.id = c.fwy_id
    where (c.time between timestamp '1996-01-01' and timestamp '1996-01-05 23:59:59'
      or c.time between timestamp '1996-01-08' and timestamp '1996-01-12 23:59:59'
      or c.time between timestamp '1996-01-15' and timestamp '1996-01-19 23:59:59')
      and (description like '1179-%' or description like '1183-%')""")
def n11(t):
    points = questions.incident_points(t.incident, t.freeways, WEEKS, ["1179", "1183"])
    path = writers.write_json_records(points, scratch_path(t.spark, "markers"))
    return t.spark.read.schema("id long, latitude double, longitude double, time timestamp_ntz, "
                               "description string, num int, direction string").json(path)


STATION_LOAD = """v as (select sensor_id, date_trunc('year', eff_start)::date as eff_start, name,
        fwy_id, (sensor_id % 7)::int as county, coalesce(nullif(sensor_id % 5, 0), -1)::int as city,
        min(num_lanes) as lanes from station_versions group by all),
    fw as (select num, row_number() over (order by num) as id
           from (select distinct fwy_id as num from v)),
    cc as (select county, city, row_number() over (order by county, city) as id from (select distinct county, city from v))"""


@query("n12_station_dimension", f"""
    with {STATION_LOAD}
    select row_number() over (order by sensor_id, eff_start) as id, sensor_id, eff_start,
      lead(eff_start) over (partition by sensor_id order by eff_start) as eff_end, v.name,
      fw.id as fwy_id, cc.id as cc_id, 6 as type_id, (sensor_id % 90) + 0.5::double as state_pm,
      lanes
    from v join fw on fw.num = v.fwy_id join cc on cc.county = v.county and cc.city = v.city""")
def n12(t):
    meta = readers.read_station_meta(t.spark, raw_station_meta(t))
    tables = loads.station_dimension(meta, t.st_type)
    return tables["traffic_station"].select("id", "sensor_id", "eff_start", "eff_end", "name",
                                            "fwy_id", "cc_id", "type_id", "state_pm", "lanes")


@query("n13_incident_fact", """
    with cc as (select county, city, row_number() over (order by
        county, city) as id
      from (select distinct (id % 3)::int as county, coalesce(nullif(id % 4, 0), -1)::int as city
            from incident))
    select i.id::int as id, i.time, case when strpos(description, '-') > 0
        then split_part(description, '-', 1) else '1' end as desc_id,
      f.id as fwy_id, cc.id as cc_id, (i.id % 70)::double as state_pm, duration
    from incident i join freeways f on f.id = i.fwy_id
    join cc on cc.county = i.id % 3 and cc.city = coalesce(nullif(i.id % 4, 0), -1)
    where i.id % 50 <> 0""")
def n13(t):
    raw = readers.read_incidents(t.spark, raw_incidents(t))
    places = dimensions.dimension(
        raw.select(F.col("county_fips_id").alias("county"),
                   F.coalesce("city_fips_id", F.lit(-1)).alias("city")), ["county", "city"])
    fact = loads.incident_fact(raw, t.freeways, places)
    return fact.select("id", "time", "desc_id", "fwy_id", "cc_id", "state_pm", "duration")


def outcomes(**tables):
    """(outcome, n): rows of each output of a load."""
    counts = [df.agg(F.lit(name).alias("outcome"), F.count("*").alias("n"))
              for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("n12_station_load_outcomes", """
    select 'matched' as outcome, count(*) as n from station_versions
    union all select 'rejected', 0 union all select 'unmatched', 0""")
def n12_outcomes(t):
    made = loads.station_dimension(readers.read_station_meta(t.spark, raw_station_meta(t)), t.st_type)
    return outcomes(**{k: made[k] for k in ("matched", "rejected", "unmatched")})


@query("n13_incident_load_outcomes", """
    select case when id % 50 = 0 then 'rejected' when fwy_id % 3 = 0 then 'unmatched'
      else 'incident' end as outcome, count(*) as n from incident group by 1""")
def n13_outcomes(t):
    raw = readers.read_incidents(t.spark, raw_incidents(t))
    places = dimensions.dimension(
        raw.select(F.col("county_fips_id").alias("county"),
                   F.coalesce("city_fips_id", F.lit(-1)).alias("city")), ["county", "city"])
    # A third of the freeways is unknown to this load.
    return outcomes(**loads.incident_load(raw, t.freeways.filter("id % 3 <> 0"), places))


@query("n14_observation_load_outcomes", """
    select case when avg_occupancy between 0 and 1 then 'observation' else 'rejected' end as outcome,
      count(*) as n from observation group by 1""")
def n14_outcomes(t):
    lines = readers.read_station_feed(t.spark, raw_feed(t))
    made = loads.observation_facts(lines, t.traffic_station)
    return outcomes(observation=made["observation"], rejected=made["rejected"]).filter("n > 0")


@query("n14_lane_load_outcomes", """
    with good as (select *, unnest(range((id % 3 + 1)::int))::int as lane from observation
                  where avg_occupancy between 0 and 1)
    select case when id % 4 >= 1 then 'lane_observation' else 'rejected_lane' end as outcome,
      count(*) as n from good group by 1""")
def n14_lane_outcomes(t):
    lines = readers.read_station_feed(t.spark, raw_feed(t))
    made = loads.observation_facts(lines, t.traffic_station)
    return outcomes(lane_observation=made["lane_observation"], rejected_lane=made["rejected_lane"])


@query("n13_incident_descriptions", """
    select distinct case when strpos(description, '-') > 0 then split_part(description, '-', 1)
        else '1' end as id, case when strpos(description, '-') > 0
        then trim(substr(description, strpos(description, '-') + 1)) else description end
        as description from incident""")
def n13_descriptions(t):
    return loads.incident_descriptions(t.incident)


FEED = """feed as (select *, station_id * 8589934592 + epoch(date_trunc('second', time))::bigint
    as observation_id from observation),
    good as (select * from feed where avg_occupancy between 0 and 1)"""


@query("n14_observation_fact", f"""
    with {FEED} select g.observation_id, g.station_id as station, g.total_flow, g.avg_speed,
      coalesce(s.id, -1) as station_version from good g
    left join traffic_station s on s.sensor_id = g.station_id and s.eff_start <= cast(g.time as date)
      and (s.eff_end is null or cast(g.time as date) < s.eff_end)""")
def n14(t):
    lines = readers.read_station_feed(t.spark, raw_feed(t))
    facts = loads.observation_facts(lines, t.traffic_station)["observation"]
    return facts.select("observation_id", "station", "total_flow", "avg_speed", "station_version")


@query("n14_lane_fact", f"""
    with {FEED} select observation_id, lane, samples, (id % 50 + lane)::int as flow
    from (select *, unnest(range((id % 3 + 1)::int))::int as lane from feed) l
    where samples >= 1 and observation_id in (select observation_id from good)""")
def n14_lanes(t):
    lines = readers.read_station_feed(t.spark, raw_feed(t))
    lanes = loads.observation_facts(lines, t.traffic_station)["lane_observation"]
    return lanes.select("observation_id", "lane", "samples", "flow")


@query("n15_hourly_precipitation", """
    select l_suppkey as station_id, l_shipdate + interval 1 hour * (l_orderkey % 24 + 1)::int as time,
      (l_partkey % 1000)::int as amount from lineitem join supplier on s_suppkey = l_suppkey
    where l_orderkey % 50 <> 0""")
def n15(t):
    records, _ = readers.read_hourly_precipitation(t.spark, raw_precipitation_lines(t))
    return loads.precipitation_facts(records, t.weather_station)["hourly"].select(
        "station_id", "time", "amount")


@query("n15_daily_precipitation", """
    select l_suppkey as station_id, cast(l_shipdate as date) as day,
      (l_partkey % 1000)::int as amount from lineitem join supplier on s_suppkey = l_suppkey
    where l_orderkey % 50 <> 0 and l_partkey % 1000 <> 0""")
def n15_daily(t):
    records, _ = readers.read_hourly_precipitation(t.spark, raw_precipitation_lines(t))
    return loads.precipitation_facts(records, t.weather_station)["daily"].select(
        "station_id", "day", "amount")


@query("n16_enriched_stations", """
    with r as (select c.o_custkey as station, case o_orderkey % 4 when 0 then 'N' when 1 then 'E'
                 when 2 then 'S' else 'W' end as direction, (o_custkey % 25)::int as freeway,
                 (o_orderkey % 2)::int as district, 'ML' as type from orders c),
    d as (select * from (select *, row_number() over (partition by station
            order by n desc, direction, freeway, district, type) as rn
          from (select station, direction, freeway, district, type, count(*) as n from r
                group by all)) where rn = 1),
    p as (select d.*, s.latitude, s.longitude from d left join current_station s on s.id = d.station),
    z as (select p.station, min(a.zip) as zip from p left join zip_area a
      on p.longitude >= a.x0 and p.longitude < a.x1 and p.latitude >= a.y0 and p.latitude < a.y1
      group by p.station)
    select p.station, p.direction, p.freeway, p.district, (z.zip < 10)::int as urban, z.zip,
           part.p_retailprice as density
    from p join z on z.station = p.station left join part on p_partkey = z.zip""")
def n16(t):
    key = F.col("o_orderkey")
    readings = t.orders.select(
        F.col("o_custkey").alias("station"), F.when(key % 4 == 0, "N").when(key % 4 == 1, "E")
        .when(key % 4 == 2, "S").otherwise("W").alias("direction"),
        (F.col("o_custkey") % 25).cast("int").alias("freeway"),
        (key % 2).cast("int").alias("district"), F.lit("ML").alias("type"))
    places = t.current_station.select(F.col("id").alias("station"), "latitude", "longitude")
    rings = spatial.rectangle_rings(t.zip_area, "zip")
    urban = rings.filter(F.col("zip") < 10).withColumnRenamed("zip", "area")
    density = t.part.select(F.col("p_partkey").alias("zip"), F.col("p_retailprice")
                            .alias("density"))
    rows = loads.enriched_stations(readings, places, urban, rings, density)
    return rows.select("station", "direction", "freeway", "district", "urban", "zip", "density")


@query("n17_home_values", """
    select p_partkey as zip, date '2008-01-01' as month, p_retailprice as avg_value from part
    union all select p_partkey, date '2008-02-01',
      case when p_partkey % 3 <> 0 then p_retailprice + 1 end from part""")
def n17(t):
    return loads.home_values(readers.read_home_values(t.spark, raw_home_values(t)))["home_value"]


@query("n17_station_update", """
    select c.id, p.p_partkey as zip, p.p_brand as metro from current_station c
    left join part p on p.p_partkey = c.id * 2""")
def n17_update(t):
    places = loads.home_values(readers.read_home_values(t.spark, raw_home_values(t)))["county_zip"]
    stations = t.current_station.select("id", (F.col("id") * 2).alias("key"))
    return dimensions.lookup(stations, places, {"key": "zip"}, {"zip": "zip", "metro": "metro"},
                             "left").drop("key")


@query("n18_station_profiles")
def n18(t):
    feed = readers.read_station_5min(t.spark, raw_feed(t))
    days = profiles.station_days(feed, strict=False, measures=["total_flow"])
    return profiles.station_profiles(days, 2)[1]


@query("n18_profile_groups", """
    select case when dayofweek(time) in (0, 6) then 'weekend' else 'weekday' end as day_part,
      count(distinct station_id) as stations from observation where lane_type = 'ML' group by 1""")
def n18_groups(t):
    feed = readers.read_station_5min(t.spark, raw_feed(t))
    days = profiles.station_days(feed, strict=False, measures=["total_flow"])
    averaged = profiles.station_profiles(days, 1)[1]
    return averaged.groupBy(F.col("part").alias("day_part")).agg(F.count("*").alias("stations"))


@query("n18_profiles_on_weekend_basis")
def n18_weekend(t):
    return profiles.station_profiles(coefficient_rows(t), 3, basis="weekend")[1]


@query("n19_collision_view", """
    select id, time, description from incident
    where description like '1179-%' or description like '1183-%'""")
def n19(t):
    writers.register_view(questions.collisions(t.incident, ["1179", "1183"]), "n19_collision")
    return t.spark.sql("select id, time, description from n19_collision")


def opened_star(t, *names):
    """The named tables of the SQL questions, saved and opened as views."""
    folder = scratch_path(t.spark, "star")
    made = {"observation": t.observation.withColumn("day", F.to_date("time")),
            "station": t.current_station, "freeway": t.freeways, "station_type": t.st_type,
            "collision_feed": t.incident}
    star.save_star({name: made[name] for name in names}, folder)
    return star.open_star(t.spark, folder, list(names))


@query("n06_slow_intervals_in_sql", f"""
    select s.name, b.bucket, round(b.f, 9) as avg_flow, round(b.v, 9) as avg_speed
    from (select station_id, {HALF_HOUR} as bucket, avg(total_flow) as f, avg(avg_speed) as v
          from observation where time between timestamp '2024-01-10' and timestamp '2024-01-20'
          group by 1, 2 having avg(avg_speed) < 4.5::double) b
    join current_station s on s.id = b.station_id join freeways f on f.id = s.fwy_id
    join st_type t on t.id = s.type_id
    where f.num = 13 and f.direction = 'E' and t.type = 'ML'""")
def n06_sql(t):
    opened_star(t, "observation", "station", "freeway", "station_type")
    return t.spark.sql("""
        select s.name, round_30m(o.time) as bucket, round(avg(o.total_flow), 9) as avg_flow,
               round(avg(o.avg_speed), 9) as avg_speed
        from station s
          left join freeway f on f.id = s.fwy_id
          left join station_type t on t.id = s.type_id, observation o
        where s.id = o.station_id and f.num = 13 and f.direction = 'E' and t.type = 'ML'
          and o.day between date '2024-01-10' and date '2024-01-20'
          and o.time between timestamp_ntz '2024-01-10' and timestamp_ntz '2024-01-20'
        group by 1, 2 having avg(o.avg_speed) < 4.5""")


@query("n08_dips_by_correlated_sql", f"""
    with {DIPS.format(bucket=QUARTER_HOUR, where='where samples <> 0')}
    select station_id, bucket, round(bucket_avg, 9) as bucket_avg from dips""")
def n08_sql(t):
    opened_star(t, "observation")
    return t.spark.sql("""
        select x.station_id, x.bucket, round(avg(x.avg_speed), 9) as bucket_avg
        from (select station_id, round_15m(time) as bucket, avg_speed from observation
              where samples <> 0) x
        group by x.station_id, x.bucket
        having avg(x.avg_speed) < (select avg(o.avg_speed) * 0.4D from observation o
            where o.station_id = x.station_id and o.day = to_date(x.bucket))""")


@query("n10_missing_coefficients_in_sql", """
    select count(*) as n from orders where dayofweek(o_orderdate) not in (0, 6)
      and o_orderkey % 3 = 0""")
def n10_sql(t):
    register_functions(t.spark)
    register_views({"coefficient_rows": t.orders.select(
        F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("weekday_coef"))})
    return t.spark.sql("""
        select count(*) as n from coefficient_rows
        where dayofweek(year_doy_to_date(year, doy)) not in (1, 7) and weekday_coef is null""")


@query("n19_collisions_near_place_in_sql", f"""
    select a.id, round({DISTANCE.format(a='p', b='a')}, 3) as metres
    from incident a, (select 32.711404::double as latitude, -117.168347::double as longitude) p
    where {DISTANCE.format(a='p', b='a')} < 15 * 1852 and description like '11%'""")
def n19_sql(t):
    opened_star(t, "collision_feed")
    return t.spark.sql("""
        select id, round(distance_m(32.711404D, -117.168347D, latitude, longitude), 3) as metres
        from collision_feed where description like '11%'
          and distance_m(32.711404D, -117.168347D, latitude, longitude) < 15 * 1852""")
