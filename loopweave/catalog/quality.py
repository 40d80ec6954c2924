"""Data quality (Q): valid rows and reject records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.registry import query
from loopweave.operators import dimensions, quality, reshape


def rejects(df, rules, record):
    """What the SQL counterpart can state: record, rule and tested fields."""
    out = quality.reject_records(df, rules, record, "validator")
    return out.select(F.col("record_no").cast("string").alias("record_no"), "rule_name",
                      F.array_join("fields", ",").alias("fields"))


@query("q01_observation_valid", """
    select id, avg_occupancy from observation where avg_occupancy between 0 and 1""")
def q01(t):
    return quality.valid_rows(t.observation, quality.observation_rules()).select(
        "id", "avg_occupancy")


@query("q01_observation_rejects", """
    select id::varchar as record_no, 'avg_occupancy in [0, 1]' as rule_name,
           'avg_occupancy' as fields from observation where not (avg_occupancy between 0 and 1)""")
def q01_rejects(t):
    return rejects(t.observation, quality.observation_rules(), "id")


def lanes_with_samples(t):
    lanes = t.lane_observation.filter(F.col("samples") != 0)
    return lanes.withColumn("record", F.concat_ws("-", "observation_id", "l_num", "flow"))


@query("q02_lane_valid", """
    select observation_id, l_num, samples, occupancy from lane_observation
    where samples <> 0 and samples >= 1 and occupancy between 0 and 1 and observed in (0, 1)""")
def q02(t):
    return quality.valid_rows(t.lane_observation.filter(F.col("samples") != 0),
                              quality.lane_rules()).select("observation_id", "l_num", "samples",
                                                           "occupancy")


@query("q02_lane_rejects_by_rule", """
    select 'occupancy in [0, 1]' as rule_name, count(*) as n from lane_observation
    where samples <> 0 and not occupancy between 0 and 1 having count(*) > 0""")
def q02_rejects(t):
    records = quality.reject_records(lanes_with_samples(t), quality.lane_rules(), "record", "lane")
    return records.groupBy("rule_name").agg(F.count("*").alias("n"))


SENSORS = """sensors as (select c_custkey as station, case when c_custkey % 9 = 0 then 'XX'
    when c_custkey % 2 = 0 then 'ml' else 'HV' end as lane_type,
    case when c_custkey % 11 = 0 then null when c_custkey % 3 = 0 then 'n' else 'W' end as direction
    from customer)"""


def sensors(t):
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("station"), F.when(key % 9 == 0, "XX").when(key % 2 == 0, "ml").otherwise("HV")
        .alias("lane_type"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 3 == 0, "n").otherwise("W")
        .alias("direction"))


@query("q03_sensor_valid", f"""
    with {SENSORS} select * from sensors where upper(lane_type) in
    ('CD','CH','FF','FR','HV','ML','OR') and upper(direction) in ('N','E','S','W')""")
def q03(t):
    return quality.valid_rows(sensors(t), quality.sensor_rules())


@query("q03_sensor_rejects", f"""
    with {SENSORS} select station::varchar as record_no, 'lane_type in list' as rule_name,
       'lane_type' as fields from sensors where lane_type = 'XX'
    union all select station::varchar, 'direction in list', 'direction' from sensors
       where direction is null""")
def q03_rejects(t):
    return rejects(sensors(t), quality.sensor_rules(), "station")


@query("q04_station_not_null", """
    select c_custkey as id from customer where c_custkey % 5 <> 0 and c_custkey % 7 <> 0""")
def q04(t):
    key = F.col("c_custkey")
    stations = t.customer.select(key.alias("id"), F.lit("ML").alias("type"),
                                 F.nullif(key % 5, F.lit(0)).alias("latitude"),
                                 F.nullif(key % 7, F.lit(0)).alias("longitude"))
    return quality.valid_rows(stations, quality.not_null("type", "latitude", "longitude")).select(
        "id")


@query("q05_incident_not_null", """
    select id::varchar as record_no, 'latitude not null' as rule_name, 'latitude' as fields
    from incident where fwy_id = 3""")
def q05(t):
    rows = t.incident.withColumn("latitude", F.when(F.col("fwy_id") != 3, F.col("latitude")))
    return rejects(rows, quality.not_null("latitude", "longitude"), "id")


RAW_PRECIPITATION = """raw as (select l_orderkey * 10 + l_linenumber as id,
    case when l_orderkey % 13 = 0 then 'XPD' else 'HPD' end as record_type,
    case when l_partkey % 17 = 0 then '05' else '04' end as state_code,
    (extract(month from l_shipdate) + case when l_suppkey % 10 = 0 then 6 else 0 end)::int as month
    from lineitem)"""


def raw_precipitation(t):
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_orderkey") % 13 == 0, "XPD").otherwise("HPD").alias("record_type"),
        F.when(F.col("l_partkey") % 17 == 0, "05").otherwise("04").alias("state_code"),
        F.lit("HPCP").alias("element_type"), F.lit("HI").alias("element_units"),
        F.lit("0012").alias("station_number"), F.lit("07").alias("division"),
        F.lit("002").alias("value_count"),
        (F.month("l_shipdate") + F.when(F.col("l_suppkey") % 10 == 0, 6).otherwise(0))
        .cast("string").alias("month"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.lpad(F.dayofmonth("l_shipdate").cast("string"), 4, "0").alias("day"))


@query("q06_precipitation_valid", f"""
    with {RAW_PRECIPITATION} select id from raw where record_type = 'HPD' and state_code = '04'
    and month between 1 and 12""")
def q06(t):
    return quality.valid_rows(raw_precipitation(t), quality.precipitation_rules()).select("id")


@query("q06_precipitation_rejects", f"""
    with {RAW_PRECIPITATION}
    select id::varchar as record_no, 'record_type is HPD' as rule_name, 'record_type' as fields
      from raw where record_type <> 'HPD'
    union all select id::varchar, 'state_code is 04', 'state_code' from raw where state_code <> '04'
    union all select id::varchar, 'month in [1, 12]', 'month' from raw where month > 12""")
def q06_rejects(t):
    return rejects(raw_precipitation(t), quality.precipitation_rules(), "id")


READINGS = """readings as (select l_orderkey * 10 + l_linenumber as id,
    extract(day from l_shipdate)::int as day, (l_orderkey % 25 + 1)::int as hour,
    case when l_partkey % 19 = 0 then 99999 when l_partkey % 5 = 0 then 0
         else (l_partkey % 100)::int end as amount,
    case l_suppkey % 6 when 0 then 'g' when 1 then '[' when 2 then 'I' when 3 then 'P'
         when 4 then ']' end as flag1,
    case when l_suppkey % 8 <> 0 then l_suppkey end as station_id from lineitem)"""


def precipitation_rows(t):
    amount = (F.when(F.col("l_partkey") % 19 == 0, 99999).when(F.col("l_partkey") % 5 == 0, 0)
              .otherwise((F.col("l_partkey") % 100).cast("int")))
    kind = F.col("l_suppkey") % 6
    flag = (F.when(kind == 0, "g").when(kind == 1, "[").when(kind == 2, "I").when(kind == 3, "P")
            .when(kind == 4, "]"))
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.dayofmonth("l_shipdate").alias("day"),
        (F.col("l_orderkey") % 25 + 1).cast("int").alias("hour"), amount.alias("amount"),
        flag.alias("flag1"),
        F.when(F.col("l_suppkey") % 8 != 0, F.col("l_suppkey")).alias("station_id"))


@query("q07_hourly_route", f"""
    with {READINGS} select id, hour, amount, flag1 from readings where hour <= 24
    and not (day = 1 and hour = 1 and coalesce(flag1, '') = 'g')
    and not (amount = 99999 and coalesce(flag1, '') in ('[', ']'))
    and id > 0 and amount >= 0 and station_id is not null""")
def q07(t):
    routed = quality.hourly_readings(precipitation_rows(t))
    return quality.valid_rows(routed, quality.hourly_rules()).select("id", "hour", "amount",
                                                                     "flag1")


@query("q08_daily_route", f"""
    with {READINGS} select id, hour, amount, flag1 from readings where hour > 24
    and not (hour = 25 and amount = 0 and flag1 is null)
    and not (amount = 0 and coalesce(flag1, '') in ('I', 'P'))
    and amount >= 0 and station_id is not null""")
def q08(t):
    routed = quality.daily_totals(precipitation_rows(t))
    return quality.valid_rows(routed, quality.daily_rules()).select("id", "hour", "amount",
                                                                    "flag1")


@query("q09_freeway_parity", """
    select id, num, direction, true as passes_observed, case when num % 2 = 0
      then direction in ('E', 'W') else direction in ('N', 'S') end as passes_strict
    from freeways""")
def q09(t):
    return t.freeways.select("id", "num", "direction",
                             quality.parity_rule().passes.alias("passes_observed"),
                             quality.parity_rule(strict=True).passes.alias("passes_strict"))


@query("q11_district_filter", """select * from freeways where district_id = 1""")
def q11(t):
    return t.freeways.filter(F.col("district_id") == 1)


@query("q12_unique_key", """
    select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2
    having count(*) > 1""")
def q12(t):
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q12_foreign_key_missing", """
    select l_orderkey, l_linenumber from lineitem where l_orderkey not in (
      select o_orderkey from orders where o_orderstatus <> 'P')""")
def q12_fk(t):
    parents = t.orders.filter(F.col("o_orderstatus") != "P")
    return dimensions.unmatched(t.lineitem.select("l_orderkey", "l_linenumber"), parents,
                                {"l_orderkey": "o_orderkey"})


@query("q13_accept_reject_split", """
    select id, coalesce(nullif(samples, 3) > 1, false) as accepted from observation""")
def q13(t):
    condition = F.nullif(F.col("samples"), F.lit(3)) > 1
    return t.observation.select("id", quality.accepted(condition).alias("accepted"))
