"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.aggregates import HALF_HOUR
from loopweave.catalog.registry import query
from loopweave.functions import calendar
from loopweave.operators import aggregates, dimensions, spatial
from loopweave.plans import loads, questions

CLOSED_INTERVALS = 8760  # days back, so that readings fall into closed station versions


@query("j01_station_type_lookup", """
    select s.id, s.type_id, t.type, t.description from traffic_station s
    join st_type t on t.id = s.type_id""")
def j01(t):
    return dimensions.lookup(t.traffic_station.select("id", "type_id"), t.st_type,
                             {"type_id": "id"}, {"type": "type", "description": "description"})


@query("j01_station_type_lookup_left", """
    select s.id, s.num_lanes, t.type from traffic_station s left join st_type t
    on t.id = s.num_lanes + 3""")
def j01_left(t):
    stations = t.traffic_station.select("id", "num_lanes",
                                        (F.col("num_lanes") + 3).alias("type_key"))
    return dimensions.lookup(stations, t.st_type, {"type_key": "id"}, {"type": "type"},
                             "left").drop("type_key")


@query("j02_station_freeway", """
    select s.id, f.id as fwy_id from (
      select id, fwy_id as num, case fwy_id % 4 when 0 then 'N' when 1 then 'E' when 2 then 'S'
        else 'N' end as direction from traffic_station) s
    join freeways f on f.num = s.num and f.direction = s.direction""")
def j02(t):
    key = F.col("fwy_id")
    named = t.traffic_station.select(
        "id", key.alias("num"), F.when(key % 4 == 0, "N").when(key % 4 == 1, "E")
        .when(key % 4 == 2, "S").otherwise("N").alias("direction"))
    return dimensions.lookup(named, t.freeways, {"num": "num", "direction": "direction"},
                             {"id": "fwy_id"}).select("id", "fwy_id")


PLACES = "select distinct n_regionkey as county, coalesce(nullif(n_nationkey % 3, 0), -1)::int as city from nation"


def places(t):
    """County and city pairs; a missing city is -1."""
    city = F.nullif(F.col("n_nationkey") % 3, F.lit(0))
    return dimensions.dimension(
        t.nation.select(F.col("n_regionkey").alias("county"), city.alias("city"))
        .fillna(-1, subset=["city"]), ["county", "city"])


@query("j03_station_county_city", f"""
    with places as ({PLACES}),
    ids as (select *, row_number() over (order by county, city) as cc_id from places)
    select c.c_custkey as id, i.cc_id from customer c join nation n on n_nationkey = c_nationkey
    join ids i on i.county = n.n_regionkey
      and i.city = coalesce(nullif(c_nationkey % 3, 0), -1)""")
def j03(t):
    city = F.nullif(F.col("c_nationkey") % 3, F.lit(0))
    stations = (t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey",
                                  city.alias("city")).fillna(-1, subset=["city"]))
    stations = dimensions.lookup(stations, t.nation, {"c_nationkey": "n_nationkey"},
                                 {"n_regionkey": "county"})
    return dimensions.lookup(stations, places(t), {"county": "county", "city": "city"},
                             {"id": "cc_id"}).select("id", "cc_id")


@query("j04_incident_freeway_county_city", f"""
    with places as ({PLACES}),
    ids as (select *, row_number() over (order by county, city) as cc_id from places)
    select c.id, f.id as freeway, i.cc_id from incident c join freeways f on f.id = c.fwy_id
    join ids i on i.county = f.district_id and i.city = coalesce(nullif(c.fwy_id % 3, 0), -1)""")
def j04(t):
    rows = (t.incident.select("id", "fwy_id", F.nullif(F.col("fwy_id") % 3, F.lit(0)).alias("city"))
            .fillna(-1, subset=["city"]))
    rows = dimensions.lookup(rows, t.freeways, {"fwy_id": "id"},
                             {"id": "freeway", "district_id": "county"})
    return dimensions.lookup(rows, places(t), {"county": "county", "city": "city"},
                             {"id": "cc_id"}).select("id", "freeway", "cc_id")


VERSION_SQL = """
    select o.id, o.station_id, coalesce(s.id, -1) as station_version
    from (select id, station_id, cast(time as date) - {back} as day from observation) o
    left join traffic_station s on s.sensor_id = o.station_id and s.eff_start <= o.day
      and (s.eff_end is null or o.day < s.eff_end)"""


def versioned(t, back):
    facts = t.observation.select("id", "station_id", F.date_sub("time", back).alias("day"))
    return dimensions.version_at(facts, t.traffic_station, "station_id", "day",
                                 "sensor_id").drop("day")


@query("j05_station_version", VERSION_SQL.format(back=0))
def j05(t):
    return versioned(t, 0)


@query("j05_station_version_closed", VERSION_SQL.format(back=CLOSED_INTERVALS))
def j05_closed(t):
    return versioned(t, CLOSED_INTERVALS)


@query("j06_end_date_from_next_version", """
    select a.id, a.eff_start, min(b.eff_start) as eff_end from traffic_station a
    left join traffic_station b on b.sensor_id = a.sensor_id and b.eff_start > a.eff_start
    group by a.id, a.eff_start""")
def j06(t):
    return t.traffic_station.select("id", "eff_start", "eff_end")


@query("j07_precipitation_weather_station", """
    select p.station_id, p.day, round(p.amount, 4) as amount, w.name
    from precipitation_daily_total p join weather_station w on w.id = p.station_id""")
def j07(t):
    rows = dimensions.lookup(t.precipitation_daily_total, t.weather_station, {"station_id": "id"},
                             {"name": "name"})
    return rows.select("station_id", "day", F.round("amount", 4).alias("amount"), "name")


@query("j08_lane_observation_join", """
    select l.observation_id, l.l_num, o.station_id, o.time, l.flow from lane_observation l
    join observation o on o.id = l.observation_id""")
def j08(t):
    lanes = t.lane_observation.select("observation_id", "l_num", "flow")
    heads = t.observation.select(F.col("id").alias("observation_id"), "station_id", "time")
    return lanes.join(heads, "observation_id").select("observation_id", "l_num", "station_id",
                                                      "time", "flow")


@query("j09_foreign_key_matched", """
    select observation_id, l_num from lane_observation
    where observation_id in (select id from observation)""")
def j09(t):
    return dimensions.matched(t.lane_observation, t.observation, {"observation_id": "id"}).select(
        "observation_id", "l_num")


@query("j09_foreign_key_unmatched", """
    select observation_id, l_num from lane_observation
    where observation_id not in (select id from observation)""")
def j09_unmatched(t):
    return dimensions.unmatched(t.lane_observation, t.observation, {"observation_id": "id"}).select(
        "observation_id", "l_num")


@query("j09_foreign_key_default", """
    select l.observation_id, l.l_num, coalesce(o.id, -1) as parent from lane_observation l
    left join observation o on o.id = l.observation_id""")
def j09_default(t):
    return dimensions.lookup(t.lane_observation.select("observation_id", "l_num"), t.observation,
                             {"observation_id": "id"}, {"id": "parent"}, "left", -1)


DISTANCE = """2 * 6371008.8::double * asin(sqrt(least(1.0::double,
    power(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude))
    * cos(radians({b}.latitude)) * power(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"""


@query("j10_regression_extract", f"""
    with homes as (select zip, m2008_01 as avg_value from home_value),
    rows as (select s.id, s.num_lanes, s.fwy_id, s.latitude, s.longitude, s.eff_start,
                    (s.sensor_id % 200)::bigint as zip
             from traffic_station s join st_type t on t.id = s.type_id and t.type = 'ML')
    select r.id as s_id, r.num_lanes, f.num as fwy_num, case f.direction when 'N' then 0
             when 'E' then 1 when 'S' then 2 else 3 end as fwy_dir, h.avg_value,
           case when c.id is null then 'F' else 'T' end as chp_inc, c.id as incident,
           c.duration as chp_duration, r.eff_start as date
    from rows r join freeways f on f.id = r.fwy_id join homes h on h.zip = r.zip
    left join incident c on cast(c.time as date) = r.eff_start and c.fwy_id = r.fwy_id
      and {DISTANCE.format(a='r', b='c')} < 30000""")
def j10(t):
    profiles = t.traffic_station.select("id", "eff_start")
    stations = t.traffic_station.select("id", "num_lanes", "fwy_id", "type_id", "latitude",
                                        "longitude", (F.col("sensor_id") % 200).alias("zip"))
    homes = t.home_value.select("zip", F.lit(None).cast("int").alias("month"),
                                F.col("m2008_01").alias("avg_value"))
    extract = loads.regression_extract(
        profiles.withColumnRenamed("eff_start", "date"), stations, t.st_type, t.freeways,
        homes, t.incident, metres=30000, monthly=False)
    return extract.select("s_id", "num_lanes", "fwy_num", "fwy_dir", "avg_value", "chp_inc",
                          "incident", "chp_duration", "date")


@query("j11_incident_near_weather_station", f"""
    select i.id, w.id as station,
      case when w.id is not null then round({DISTANCE.format(a='i', b='w')}, 3) end as metres
    from incident i left join weather_station w on w.fwy_id = i.fwy_id
      and {DISTANCE.format(a='i', b='w')} < 8046.72""")
def j11(t):
    joined = spatial.near_join(t.incident, t.weather_station, 8046.72, {"fwy_id": "fwy_id"})
    return joined.select("id", F.col("id_r").alias("station"), F.round("metres", 3).alias("metres"))


@query("j11_incident_near_station_same_day", f"""
    select i.id, s.id as station from
      (select *, cast(time as date) as day from incident) i
    left join (select *, cast(eff_start as date) as day from traffic_station) s
      on s.fwy_id = i.fwy_id and s.day = i.day and {DISTANCE.format(a='i', b='s')} < 20000""")
def j11_day(t):
    incidents = t.incident.withColumn("day", F.to_date("time"))
    joined = spatial.near_join(incidents, t.traffic_station, 20000,
                               {"fwy_id": "fwy_id", "day": "eff_start"})
    return joined.select("id", F.col("id_r").alias("station"))


@query("j12_radius_membership", """
    select p.station_id, p.day, round(p.amount, 4) as amount from precipitation_daily_total p
    where p.station_id in (select id from weather_station where
      2 * 6371008.8::double * asin(sqrt(least(1.0::double,
        power(sin(radians(latitude - 32.711404::double) / 2), 2)
        + cos(radians(32.711404::double)) * cos(radians(latitude))
        * power(sin(radians(longitude + 117.168347::double) / 2), 2)))) < 15 * 1852)""")
def j12(t):
    near = spatial.within(t.weather_station, 32.711404, -117.168347, 15 * 1852)
    return (dimensions.matched(t.precipitation_daily_total, near, {"station_id": "id"})
            .select("station_id", "day", F.round("amount", 4).alias("amount")))


@query("j13_comma_join", """
    select o.id, f.num, f.direction from observation o, current_station s, freeways f
    where s.id = o.station_id and s.fwy_id = f.id and s.type_id = 6""")
def j13(t):
    stations = t.current_station.filter(F.col("type_id") == 6).select(
        F.col("id").alias("station_id"), "fwy_id")
    freeways = t.freeways.select(F.col("id").alias("fwy_id"), "num", "direction")
    return (t.observation.join(stations, "station_id").join(freeways, "fwy_id")
            .select("id", "num", "direction"))


DIPS = """
    b as (select station_id, {bucket} as bucket, avg(avg_speed) as a
          from observation {where} group by 1, 2),
    d as (select station_id, cast(time as date) as day, avg(avg_speed) as a
          from observation group by 1, 2),
    dips as (select b.station_id, b.bucket, b.a as bucket_avg from b
             join d on d.station_id = b.station_id and d.day = cast(b.bucket as date)
             where b.a < 0.4::double * d.a)"""
QUARTER_HOUR = HALF_HOUR.replace("30", "15")


@query("j14_day_and_bucket_inequality", f"""
    with {DIPS.format(bucket="date_trunc('hour', time)", where='')}
    select station_id, bucket, round(bucket_avg, 9) as bucket_avg from dips""")
def j14(t):
    hourly = t.observation.withColumn("time", calendar.hour_floor(F.col("time")))
    dips = aggregates.dips_below_day(hourly, 30)
    return dips.select("station_id", "bucket", F.round("bucket_avg", 9).alias("bucket_avg"))


@query("j15_similar_speed_pairs", f"""
    with {DIPS.format(bucket=QUARTER_HOUR, where='where samples <> 0')},
    f as (select dips.*, fr.num, fr.direction from dips join current_station s
            on s.id = dips.station_id join freeways fr on fr.id = s.fwy_id)
    select distinct a.num as num_1, a.direction as direction_1, b.num as num_2,
           b.direction as direction_2
    from f a join f b on a.bucket = b.bucket
      and b.bucket_avg between a.bucket_avg * 0.9::double and a.bucket_avg * 1.1::double""")
def j15(t):
    return questions.similar_freeways(t.observation, t.current_station, t.freeways)


@query("j16_week_over_week", """
    select s.id as station_id, s.name, round(w2.a - w1.a, 9) as delta from
      (select station_id, avg(avg_speed) as a from observation where time between
        timestamp '2024-01-01 00:00:00' and timestamp '2024-01-07 23:59:59'
        group by 1 having avg(avg_speed) > 0) w1
      join (select station_id, avg(avg_speed) as a from observation where time between
        timestamp '2024-01-08 00:00:00' and timestamp '2024-01-14 23:59:59'
        group by 1 having avg(avg_speed) > 0) w2 on w1.station_id = w2.station_id
      join current_station s on s.id = w1.station_id""")
def j16(t):
    weeks = questions.week_averages(t.observation, t.current_station, "2024-01-01", "2024-01-08")
    return weeks.select("station_id", "name",
                        F.round(F.col("week_two") - F.col("week_one"), 9).alias("delta"))


@query("j17_labels_with_vectors", """
    select a.vec_id, a.label, i::int as slot, b.embedding[i + 1] as value from embeddings a
    join embeddings b on a.vec_id = b.vec_id, range(64) r(i)""")
def j17(t):
    labels = t.embeddings.select(F.struct("vec_id").alias("key"), "label")
    vectors = t.embeddings.select(F.struct("vec_id").alias("key"), "embedding")
    return (labels.join(vectors, "key")
            .select("key.vec_id", "label", F.posexplode("embedding").alias("slot", "value")))


@query("j18_features_with_station_metadata", """
    select o.id, s.name, s.type_id, s.num_lanes, o.total_flow from observation o
    join current_station s on s.id = o.station_id""")
def j18(t):
    meta = {"name": "name", "type_id": "type_id", "num_lanes": "num_lanes"}
    return dimensions.lookup(t.observation.select("id", "station_id", "total_flow"),
                             t.current_station, {"station_id": "id"}, meta).drop("station_id")


@query("j19_point_in_polygon", """
    select s.id, min(z.zip) as zip from traffic_station s left join zip_area z
      on s.longitude >= z.x0 and s.longitude < z.x1 and s.latitude >= z.y0 and s.latitude < z.y1
    group by s.id""")
def j19(t):
    rings = spatial.rectangle_rings(t.zip_area, "zip")
    return spatial.containing_area(t.traffic_station, rings, "zip", "zip").select("id", "zip")


#: Corners of an area's rings, in tenths of its rectangle: outline, hole, and two islands.
RINGS = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 3), (5, 8), (8, 3)],
         [(4, 4), (6, 4), (6, 5), (4, 5)], [(12, 1), (15, 4), (13, 9), (11, 6)]]


def _closed(ring):
    return [*ring, ring[0]]


EDGES = ", ".join(f"({a}, {b}, {c}, {d})" for ring in map(_closed, RINGS)
                  for (a, b), (c, d) in zip(ring, ring[1:]))


@query("j19_areas_with_holes_and_parts", f"""
    with e as (select zip, x0 + ex * 0.02::double as xa, y0 + ey * 0.02::double as ya,
        x0 + fx * 0.02::double as xb, y0 + fy * 0.02::double as yb
      from zip_area, (values {EDGES}) t(ex, ey, fx, fy)),
    p as (select distinct longitude as x, latitude as y from traffic_station),
    odd as (select p.x, p.y, zip from p join e on (ya > y) <> (yb > y)
              and x < xa + (xb - xa) * (y - ya) / (yb - ya)
            group by all having count(*) % 2 = 1),
    first as (select x, y, min(zip) as zip from odd group by x, y)
    select s.id, first.zip from traffic_station s left join first
      on first.x = s.longitude and first.y = s.latitude""")
def j19_holes(t):
    """Areas of an outline with a hole, an island in it and a second part that leans over."""
    def corner(x, y):
        return F.struct((F.col("x0") + F.lit(x) * F.lit(0.02)).alias("x"),
                        (F.col("y0") + F.lit(y) * F.lit(0.02)).alias("y"))

    areas = t.zip_area.select("zip", F.array(*[F.array(*[corner(x, y) for x, y in _closed(ring)])
                                               for ring in RINGS]).alias("rings"))
    return spatial.containing_area(t.traffic_station, areas, "zip", "zip").select("id", "zip")


@query("j20_update_by_key", """
    select c_custkey as sensor_id, p_partkey as zip, case when p_partkey is null then 0
             else coalesce(nullif(p_size % 3, 0), 0) end::int as urban,
           p_retailprice as density
    from customer left join part on p_partkey = c_custkey * 2""")
def j20(t):
    stations = t.customer.select(F.col("c_custkey").alias("sensor_id"),
                                 (F.col("c_custkey") * 2).alias("key"),
                                 F.lit(None).cast("bigint").alias("zip"), F.lit(0).alias("urban"),
                                 F.lit(None).cast("double").alias("density"))
    changes = t.part.select("p_partkey", F.nullif(F.col("p_size") % 3, F.lit(0)).alias("urban"),
                            "p_retailprice")
    updated = dimensions.update_by_key(
        stations, changes, {"key": "p_partkey"},
        {"p_partkey": "zip", "urban": "urban", "p_retailprice": "density"}, {"urban": 0})
    return updated.drop("key")


@query("j21_station_zip_density", """
    select s.id, s.zip, p.p_retailprice as density from
      (select id, id * 3 as zip from current_station) s left join part p on p.p_partkey = s.zip""")
def j21(t):
    stations = t.current_station.select("id", (F.col("id") * 3).alias("zip"))
    return dimensions.lookup(stations, t.part, {"zip": "p_partkey"}, {"p_retailprice": "density"},
                             "left")


@query("j22_id_set_filter", """
    select id, station_id, station_id in (select c_custkey from customer where c_acctbal < 0)
           as kept from observation""")
def j22(t):
    chosen = t.customer.filter(F.col("c_acctbal") < 0)
    rows = t.observation.select("id", "station_id")
    return dimensions.with_match(rows, chosen, {"station_id": "c_custkey"}, "kept")


@query("j23_left_outer_chain", """
    select o.id, s.fwy_id, t.type, f.num from observation o
    left join current_station s on s.id = o.station_id * 2
    left join st_type t on t.id = s.type_id left join freeways f on f.id = s.fwy_id""")
def j23(t):
    rows = t.observation.select("id", (F.col("station_id") * 2).alias("key"))
    rows = dimensions.lookup(rows, t.current_station, {"key": "id"},
                             {"fwy_id": "fwy_id", "type_id": "type_id"}, "left")
    rows = dimensions.lookup(rows, t.st_type, {"type_id": "id"}, {"type": "type"}, "left")
    return dimensions.lookup(rows, t.freeways, {"fwy_id": "id"}, {"num": "num"},
                             "left").select("id", "fwy_id", "type", "num")
