"""Projections, filters and scalar expressions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from loopweave.catalog.registry import query
from loopweave.functions import calendar, geo, scalars
from loopweave.operators import reshape
from loopweave.schemas import DIRECTION_FROM_ONE, DIRECTION_FROM_ZERO


@query("p01_select_measure_columns", """
    select vec_id as station_id, label as district_id, i::int as slot,
           embedding[i + 1]::double as total_flow from embeddings, range(64) r(i)""")
def p01(t):
    wide = reshape.spread_slots(
        t.embeddings.select(F.col("vec_id").alias("station_id"), F.col("label").alias("district_id"),
                            F.col("embedding").cast("array<double>").alias("total_flow"),
                            F.reverse("embedding").cast("array<double>").alias("speed")),
        ["total_flow", "speed"], slots=64)
    keys = ["station_id", "district_id"]
    chosen = reshape.select_measure(wide, "total_flow", keys=keys, slots=64)
    cells = F.array(*[c for c in chosen.columns if c not in keys])
    return chosen.select(*keys, F.posexplode(cells).alias("slot", "total_flow"))


@query("p02_row_to_vector", """
    select vec_id, label, len(embedding)::int as n, embedding[1]::double as first_value,
           embedding[64]::double as last_value from embeddings""")
def p02(t):
    wide = t.embeddings.select("vec_id", "label", *[
        F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    packed = reshape.to_vector(wide, ["vec_id", "label"], [f"x{i}" for i in range(64)], "values")
    return packed.select("vec_id", "label", F.size("values").alias("n"),
                         F.col("values")[0].alias("first_value"),
                         F.element_at("values", -1).alias("last_value"))


@query("p03_cast_drop_rename", """
    select id, num::double as num, direction as travel_direction from freeways""")
def p03(t):
    return (t.freeways.withColumn("num", F.col("num").cast("double")).drop("district_id")
            .withColumnRenamed("direction", "travel_direction"))


@query("p04_mainline_filter", """
    select id, station_id, lane_type, total_flow from observation where lane_type = 'ML'""")
def p04(t):
    return (t.observation.filter(F.col("lane_type") == "ML")
            .select("id", "station_id", "lane_type", "total_flow"))


@query("p05_weekday_weekend_split", """
    select id, time, case when dayofweek(time) in (0, 6) then 'weekend' else 'weekday' end as part
    from observation""")
def p05(t):
    part = F.when(calendar.is_weekend(F.col("time")), "weekend").otherwise("weekday")
    return t.observation.select("id", "time", part.alias("part"))


@query("p06_in_list_filter", """
    select id, sensor_id, fwy_id, eff_start from traffic_station where fwy_id in (5, 8, 15)""")
def p06(t):
    return (t.traffic_station.filter(F.col("fwy_id").isin(5, 8, 15))
            .select("id", "sensor_id", "fwy_id", "eff_start"))


@query("p07_time_range", """
    select id, time from observation
    where time between timestamp '2024-01-08 00:00:00' and timestamp '2024-01-14 23:59:59'""")
def p07(t):
    return (t.observation
            .filter(F.col("time").between(F.expr("timestamp_ntz'2024-01-08 00:00:00'"),
                                          F.expr("timestamp_ntz'2024-01-14 23:59:59'")))
            .select("id", "time"))


@query("p08_hour_range", """
    select id, time, avg_speed from observation where extract(hour from time) between 15 and 19""")
def p08(t):
    return (t.observation.filter(F.hour("time").between(15, 19))
            .select("id", "time", "avg_speed"))


@query("p09_date_list", """
    select id, time, total_flow from observation where cast(time as date) in
    (date '2024-01-01', date '2024-01-08', date '2024-01-15', date '2024-01-22')""")
def p09(t):
    days = [F.lit(d).cast("date") for d in
            ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22")]
    return (t.observation.filter(F.to_date("time").isin(*days))
            .select("id", "time", "total_flow"))


@query("p10_safe_cast_null", """
    select event_id, try_cast(substr(props, 7, 2) as int) as k,
           try_cast(event_type as double) as bad from events""")
def p10(t):
    return t.events.select(
        "event_id", scalars.number_or_null(F.substring("props", 7, 2), "int").alias("k"),
        scalars.number_or_null(F.col("event_type")).alias("bad"))


@query("p11_safe_cast_zero", """
    select event_id, coalesce(try_cast(substr(props, 7, 2) as int), 0) as k,
           coalesce(try_cast(event_type as double), 0.0::double) as bad from events""")
def p11(t):
    return t.events.select(
        "event_id", scalars.number_or_zero(F.substring("props", 7, 2), "int").alias("k"),
        scalars.number_or_zero(F.col("event_type")).alias("bad"))


@query("p12_blank_as_zero", """
    select p_partkey, coalesce(nullif(case when p_size % 5 = 0 then '' when p_size % 7 = 0 then null
           else cast(p_size as varchar) end, ''), '0')::int as size_value from part""")
def p12(t):
    raw = (F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 7 == 0, F.lit(None))
           .otherwise(F.col("p_size").cast("string")))
    return t.part.select("p_partkey", scalars.blank_as_zero(raw).cast("int").alias("size_value"))


@query("p13_postmile_cleanup", """
    select p_partkey, case p_partkey % 4 when 3 then 0.0::double
        else (cast(p_size as varchar) || '.' || cast(p_partkey % 10 as varchar))::double
        end as postmile from part""")
def p13(t):
    number = F.concat(F.col("p_size").cast("string"), F.lit("."),
                      (F.col("p_partkey") % 10).cast("string"))
    kind = F.col("p_partkey") % 4
    raw = (F.when(kind == 0, number).when(kind == 1, F.concat(F.lit("R"), number))
           .when(kind == 2, F.concat(F.lit("TM"), number)).otherwise("R"))
    return t.part.select("p_partkey", scalars.postmile(raw).alias("postmile"))


@query("p14_date_from_file_name", """
    select o_orderkey, cast(o_orderdate as date) as file_date from orders""")
def p14(t):
    path = F.concat(F.lit("/feeds/d11_text_meta_"), F.date_format("o_orderdate", "yyyy_MM_dd"),
                    F.lit(".txt"))
    return t.orders.select("o_orderkey", scalars.date_in_path(path).alias("file_date"))


@query("p15_split_incident_code", """
    select id, case when strpos(description, '-') > 0 then trim(split_part(description, '-', 1))
               when description = 'CLOSURE of a Road' then '1' end as code,
           case when strpos(description, '-') > 0
               then trim(substr(description, strpos(description, '-') + 1))
               else trim(description) end as text from incident""")
def p15(t):
    text = F.col("description")
    return t.incident.select("id", scalars.incident_code(text).alias("code"),
                             scalars.incident_text(text).alias("text"))


@query("p16_dms_to_decimal", """
    select s_suppkey, round((case when s_suppkey % 2 = 0 then -1.0::double else 1.0::double end) *
        ((s_suppkey % 180)::double + (s_suppkey % 60)::double / 60.0::double
         + (s_suppkey * 7 % 60)::double / 3600.0::double), 6) + 0.0::double as angle from supplier""")
def p16(t):
    key = F.col("s_suppkey")
    angle = scalars.decimal_degrees(key % 180, key % 60, key * 7 % 60,
                                    F.when(key % 2 == 0, "-").otherwise(" "))
    return t.supplier.select("s_suppkey", F.round(angle, 6).alias("angle"))


@query("p17_strip_id_prefix", """
    select s_suppkey, cast(s_suppkey as int) as station from supplier""")
def p17(t):
    raw = F.concat(F.lit("04"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    return t.supplier.select("s_suppkey", scalars.id_without_prefix(raw).alias("station"))


@query("p18_year_day_to_date", """
    select o_orderkey, cast(o_orderdate as date) as day from orders""")
def p18(t):
    return t.orders.select("o_orderkey", calendar.date_of_year_day(
        F.year("o_orderdate"), F.dayofyear("o_orderdate")).alias("day"))


@query("p19_calendar_fields", """
    select id, extract(year from time)::int as year, extract(doy from time)::int as day_of_year,
           (dayofweek(time) + 1)::int as day_of_week, extract(month from time)::int as month,
           strftime(time, '%H:%M') as time_of_day from observation""")
def p19(t):
    time = F.col("time")
    return t.observation.select(
        "id", F.year(time).alias("year"), F.dayofyear(time).alias("day_of_year"),
        F.dayofweek(time).alias("day_of_week"), F.month(time).alias("month"),
        F.date_format(time, "HH:mm").alias("time_of_day"))


@query("p20_weekday_monday_zero", """
    select o_orderkey, (isodow(o_orderdate) - 1)::int as weekday from orders""")
def p20(t):
    text = F.date_format("o_orderdate", "MM-dd-yyyy")
    return t.orders.select("o_orderkey", calendar.monday_zero(F.to_date(text, "MM-dd-yyyy"))
                           .alias("weekday"))


@query("p21_nearest_bucket", """
    select id, date_trunc('hour', time) + interval 1 minute * (30 *
               round_even(extract(minute from time) / 30.0::double, 0))::int as half_hour,
           date_trunc('hour', time) + interval 1 minute * (15 *
               round_even(extract(minute from time) / 15.0::double, 0))::int as quarter_hour
    from observation""")
def p21(t):
    return t.observation.select("id", calendar.nearest_bucket(F.col("time"), 30).alias("half_hour"),
                                calendar.nearest_bucket(F.col("time"), 15).alias("quarter_hour"))


@query("p22_truncate_day_hour", """
    select id, cast(time as date) as day, date_trunc('hour', time) as hour from observation""")
def p22(t):
    return t.observation.select("id", F.to_date("time").alias("day"),
                                calendar.hour_floor(F.col("time")).alias("hour"))


@query("p23_timestamp_from_parts", """
    select o_orderkey, cast(o_orderdate as date) as day,
           o_orderdate + interval 1 hour * (o_orderkey % 25)::int as reading_time from orders""")
def p23(t):
    day = F.col("o_orderdate")
    parts = F.year(day), F.month(day), F.dayofmonth(day)
    return t.orders.select(
        "o_orderkey", F.make_date(*parts).alias("day"),
        calendar.from_parts(*parts, (F.col("o_orderkey") % 25).cast("int")).alias("reading_time"))


@query("p24_explode_precipitation", """
    with src as (select l_orderkey, l_linenumber, (l_orderkey % 24 + 1)::int as h,
                        (l_partkey % 1000)::int as amount, l_returnflag as flag,
                        (l_orderkey % 11 = 0) as wrong from lineitem)
    select l_orderkey, l_linenumber, h as hour, amount, flag as flag1, null::varchar as flag2
    from src where not wrong
    union all
    select l_orderkey, l_linenumber, 25, amount, 'I', 'g' from src where not wrong""")
def p24(t):
    amount = F.lpad((F.col("l_partkey") % 1000).cast("string"), 5, "0")
    hour = F.lpad(((F.col("l_orderkey") % 24 + 1) * 100).cast("string"), 4, "0")
    values = F.concat(F.lit(" "), hour, F.lit(" "), amount, F.col("l_returnflag"),
                      F.lit("  2500 "), amount, F.lit("Ig"))
    declared = F.when(F.col("l_orderkey") % 11 == 0, 3).otherwise(2)
    records = t.lineitem.select("l_orderkey", "l_linenumber", values.alias("values"),
                                declared.alias("value_count"))
    return reshape.explode_precipitation(records)


@query("p25_direction_and_flag_codes", """
    select i.id, case f.direction when 'N' then 1 when 'S' then 2 when 'E' then 3 when 'W' then 4
             else -1 end as code_from_one,
           case f.direction when 'N' then 0 when 'E' then 1 when 'S' then 2 when 'W' then 3
             else -1 end as code_from_zero,
           case when i.duration > 60 then 'T' else 'F' end as long_incident
    from incident i join freeways f on f.id = i.fwy_id""")
def p25(t):
    joined = t.incident.join(t.freeways.select(F.col("id").alias("fwy"), "direction"),
                             F.col("fwy_id") == F.col("fwy"))
    direction = F.col("direction")
    return joined.select(
        "id", scalars.direction_code(direction, DIRECTION_FROM_ONE).alias("code_from_one"),
        scalars.direction_code(direction, DIRECTION_FROM_ZERO).alias("code_from_zero"),
        scalars.yes_no(F.col("duration") > 60).alias("long_incident"))


@query("p26_point_text", """
    select id, printf('POINT(%.6f %.6f)', longitude, latitude) as location from weather_station""")
def p26(t):
    return t.weather_station.select(
        "id", scalars.point_text(F.col("latitude"), F.col("longitude")).alias("location"))


@query("p27_composite_key_text", """
    select vec_id || '_' || label as key_text, vec_id as station_id, label as district_id
    from embeddings""")
def p27(t):
    text = t.embeddings.select(scalars.key_text(F.col("vec_id"), F.col("label")).alias("key_text"))
    station, district = scalars.key_parts(F.col("key_text"), ["bigint", "int"])
    return text.select("key_text", station.alias("station_id"), district.alias("district_id"))


@query("p28_fill_and_drop_missing", """
    with src as (select p_partkey, nullif(p_size % 5, 0) as city, nullif(p_partkey % 3, 0) as lat,
                        nullif(p_partkey % 2, 0) as lon from part)
    select p_partkey, coalesce(city, -1)::int as city, lat, lon from src
    where lat is not null or lon is not null""")
def p28(t):
    rows = t.part.select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("city"),
                         F.nullif(F.col("p_partkey") % 3, F.lit(0)).alias("lat"),
                         F.nullif(F.col("p_partkey") % 2, F.lit(0)).alias("lon"))
    return rows.fillna(-1, subset=["city"]).dropna(how="all", subset=["lat", "lon"])


@query("p29_interval_arithmetic", """
    select id, round(total_flow * 288.0::double, 4) as per_day,
           round((total_flow - avg_speed) * 288.0::double, 4) as delta_per_day,
           round(total_flow * 4.0::double, 4) as times_four from observation""")
def p29(t):
    flow = F.col("total_flow")
    return t.observation.select(
        "id", F.round(flow * 288.0, 4).alias("per_day"),
        F.round((flow - F.col("avg_speed")) * 288.0, 4).alias("delta_per_day"),
        F.round(flow * 4.0, 4).alias("times_four"))


@query("p30_normalise_by_max", """
    select c_custkey, abs(c_acctbal) as magnitude, c_acctbal < 0 as negative,
           round(abs(c_acctbal) / max(abs(c_acctbal)) over (), 9) as normalised from customer""")
def p30(t):
    rows = t.customer.select("c_custkey", F.abs("c_acctbal").alias("magnitude"),
                             (F.col("c_acctbal") < 0).alias("negative"))
    largest = rows.agg(F.max("magnitude")).scalar()
    return rows.withColumn("normalised", F.round(F.col("magnitude") / largest, 9))


@query("p31_rename_and_drop_list", """
    select sensor_id as s_id, num_lanes as lanes, latitude as lat, longitude as lon
    from traffic_station""")
def p31(t):
    return (t.traffic_station.withColumnsRenamed(
        {"sensor_id": "s_id", "num_lanes": "lanes", "latitude": "lat", "longitude": "lon"})
        .drop("id", "eff_start", "eff_end", "name", "fwy_id", "type_id"))


@query("p32_freeway_filter_sorted", """
    select id, name, fwy_id, type_id, latitude from current_station
    where fwy_id = 5 and type_id not in (5, 7) order by latitude, id""")
def p32(t):
    return (t.current_station.filter((F.col("fwy_id") == 5) & ~F.col("type_id").isin(5, 7))
            .select("id", "name", "fwy_id", "type_id", "latitude").orderBy("latitude", "id"))


@query("p33_great_circle_distance", """
    select id, round(2 * 6371008.8::double * asin(sqrt(least(1.0::double,
        power(sin(radians(latitude - 32.711404::double) / 2), 2)
        + cos(radians(32.711404::double)) * cos(radians(latitude))
        * power(sin(radians(longitude + 117.168347::double) / 2), 2)))), 3) as metres
    from weather_station""")
def p33(t):
    metres = geo.distance_m(F.lit(32.711404), F.lit(-117.168347), F.col("latitude"),
                            F.col("longitude"))
    return t.weather_station.select("id", F.round(metres, 3).alias("metres"))
