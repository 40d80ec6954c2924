"""Road-network views over the given test tables, for Spark and as SQL text."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.operators import dimensions
from loopweave.schemas import STATION_TYPES

_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _lat(key):
    return F.lit(32.5) + (key % 1000) / F.lit(1000.0)


def _lon(key):
    return F.lit(-117.3) + (key % 1000) / F.lit(1000.0)


class Tables:
    """Lazy DataFrames for the base tables and the views mapped onto them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in _BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def district(self) -> DataFrame:
        return self.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def st_type(self) -> DataFrame:
        return self.spark.createDataFrame(STATION_TYPES, "id int, type string, description string")

    @cached_property
    def freeways(self) -> DataFrame:
        key = F.col("n_nationkey")
        direction = (F.when(key % 4 == 0, "N").when(key % 4 == 1, "E")
                     .when(key % 4 == 2, "S").otherwise("W"))
        return self.nation.select(key.alias("id"), key.alias("num"), direction.alias("direction"),
                                  F.col("n_regionkey").alias("district_id"))

    @cached_property
    def station_versions(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.orders.join(self.customer, F.col("o_custkey") == key)
            .select(key.alias("sensor_id"), F.to_date("o_orderdate").alias("eff_start"),
                    F.col("c_name").alias("name"), F.col("c_nationkey").alias("fwy_id"),
                    (key % 3 + 5).cast("int").alias("type_id"),
                    _lat(key * 37).alias("latitude"), _lon(key * 91).alias("longitude"),
                    (F.col("o_orderkey") % 6 + 1).cast("int").alias("num_lanes"))
        )

    @cached_property
    def traffic_station(self) -> DataFrame:
        return dimensions.numbered_history(self.station_versions, "sensor_id", "eff_start",
                                           tie_break=["num_lanes"]).select(
            "id", "sensor_id", "eff_start", "eff_end", "name", "fwy_id", "type_id",
            "latitude", "longitude", "num_lanes")

    @cached_property
    def current_station(self) -> DataFrame:
        """One open row per sensor, straight from the customer table."""
        key = F.col("c_custkey")
        return self.customer.select(
            key.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("fwy_id"),
            (key % 3 + 5).cast("int").alias("type_id"), _lat(key * 37).alias("latitude"),
            _lon(key * 91).alias("longitude"), (key % 6 + 1).cast("int").alias("num_lanes"))

    @cached_property
    def observation(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            F.col("event_id").alias("id"), F.col("ts").alias("time"),
            F.col("user_id").alias("station_id"),
            F.when(kind == "error", "OR").when(kind == "signup", "HV").otherwise("ML")
            .alias("lane_type"),
            (F.col("event_id") % 4).cast("int").alias("samples"),
            F.col("value").alias("total_flow"), (F.col("value") / 10.0).alias("avg_speed"),
            (F.col("value") / 100.0).alias("avg_occupancy"))

    @cached_property
    def lane_observation(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("observation_id"), F.col("l_linenumber").alias("l_num"),
            (F.col("l_quantity").cast("int") % 4).alias("samples"),
            F.col("l_extendedprice").alias("flow"), (F.col("l_discount") * 12.0).alias("occupancy"),
            (F.col("l_tax") * 1000.0).alias("avg_speed"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("observed"))

    @cached_property
    def incident(self) -> DataFrame:
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        return self.orders.select(
            key.alias("id"), F.col("o_orderdate").alias("time"),
            F.when(status == "F", "1179-Traffic Collision - Ambulance")
            .when(status == "O", "1183-Traffic Collision").otherwise("CLOSURE of a Road")
            .alias("description"),
            _lat(key * 53).alias("latitude"), _lon(key * 17).alias("longitude"),
            (F.col("o_custkey") % 25).cast("int").alias("fwy_id"),
            (F.col("o_totalprice").cast("int") % 120).alias("duration"))

    @cached_property
    def weather_station(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.supplier.select(
            key.alias("id"), F.col("s_name").alias("name"), _lat(key * 53).alias("latitude"),
            _lon(key * 17).alias("longitude"), F.col("s_acctbal").alias("elevation"),
            F.col("s_nationkey").alias("fwy_id"))

    @cached_property
    def precipitation_daily_total(self) -> DataFrame:
        return (self.lineitem
                .groupBy(F.col("l_suppkey").alias("station_id"),
                         F.to_date("l_shipdate").alias("day"))
                .agg(F.sum("l_tax").alias("amount")))

    @cached_property
    def home_value(self) -> DataFrame:
        price = F.col("p_retailprice")
        return self.part.select(F.col("p_partkey").alias("zip"), price.alias("m2008_01"),
                                (price * 1.5).alias("m2008_02"),
                                F.lit(None).cast("double").alias("m2007_12"))

    @cached_property
    def zip_area(self) -> DataFrame:
        key = F.col("n_nationkey")
        y0 = F.lit(32.5) + (key % 5) * F.lit(0.2)
        x0 = F.lit(-117.3) + F.floor(key / 5.0).cast("int") * F.lit(0.2)
        return self.nation.select(key.alias("zip"), y0.alias("y0"), (y0 + 0.2).alias("y1"),
                                  x0.alias("x0"), (x0 + 0.2).alias("x1"))


VIEW_SQL: dict[str, str] = {
    "district": "select r_regionkey as id, r_name as name from region",
    "st_type": "select * from (values (1,'CD','Coll/Dist'),(2,'CH','Conventional Highway'),"
               "(3,'FF','Fwy-Fwy connector'),(4,'FR','Off Ramp'),(5,'HV','HOV'),"
               "(6,'ML','Mainline'),(7,'OR','On Ramp')) as t(id,type,description)",
    "freeways": "select n_nationkey as id, n_nationkey as num, case n_nationkey % 4 when 0 then 'N' "
                "when 1 then 'E' when 2 then 'S' else 'W' end as direction, "
                "n_regionkey as district_id from nation",
    "station_versions": """select c.c_custkey as sensor_id, cast(o.o_orderdate as date) as eff_start,
        c.c_name as name, c.c_nationkey as fwy_id, cast(c.c_custkey % 3 + 5 as int) as type_id,
        32.5E0 + (c.c_custkey * 37 % 1000) / 1000.0E0 as latitude,
        -117.3E0 + (c.c_custkey * 91 % 1000) / 1000.0E0 as longitude,
        cast(o.o_orderkey % 6 + 1 as int) as num_lanes
        from customer c join orders o on o.o_custkey = c.c_custkey""",
    "traffic_station": """select row_number() over (order by sensor_id, eff_start) as id, sensor_id,
        eff_start, lead(eff_start) over (partition by sensor_id order by eff_start) as eff_end,
        name, fwy_id, type_id, latitude, longitude, num_lanes
        from (select *, row_number() over (partition by sensor_id, eff_start order by num_lanes) as rn
              from station_versions) t where rn = 1""",
    "current_station": """select c_custkey as id, c_name as name, c_nationkey as fwy_id,
        cast(c_custkey % 3 + 5 as int) as type_id,
        32.5E0 + (c_custkey * 37 % 1000) / 1000.0E0 as latitude,
        -117.3E0 + (c_custkey * 91 % 1000) / 1000.0E0 as longitude,
        cast(c_custkey % 6 + 1 as int) as num_lanes from customer""",
    "observation": """select event_id as id, ts as time, user_id as station_id,
        case event_type when 'error' then 'OR' when 'signup' then 'HV' else 'ML' end as lane_type,
        cast(event_id % 4 as int) as samples, value as total_flow, value / 10.0E0 as avg_speed,
        value / 100.0E0 as avg_occupancy from events""",
    "lane_observation": """select l_orderkey as observation_id, l_linenumber as l_num,
        cast(l_quantity as int) % 4 as samples, l_extendedprice as flow,
        l_discount * 12.0E0 as occupancy, l_tax * 1000.0E0 as avg_speed,
        case l_linestatus when 'F' then 1 else 0 end as observed from lineitem""",
    "incident": """select o_orderkey as id, o_orderdate as time,
        case o_orderstatus when 'F' then '1179-Traffic Collision - Ambulance'
          when 'O' then '1183-Traffic Collision' else 'CLOSURE of a Road' end as description,
        32.5E0 + (o_orderkey * 53 % 1000) / 1000.0E0 as latitude,
        -117.3E0 + (o_orderkey * 17 % 1000) / 1000.0E0 as longitude,
        cast(o_custkey % 25 as int) as fwy_id, cast(trunc(o_totalprice) as int) % 120 as duration
        from orders""",
    "weather_station": """select s_suppkey as id, s_name as name,
        32.5E0 + (s_suppkey * 53 % 1000) / 1000.0E0 as latitude,
        -117.3E0 + (s_suppkey * 17 % 1000) / 1000.0E0 as longitude, s_acctbal as elevation,
        s_nationkey as fwy_id from supplier""",
    "precipitation_daily_total": """select l_suppkey as station_id, cast(l_shipdate as date) as day,
        sum(l_tax) as amount from lineitem group by l_suppkey, cast(l_shipdate as date)""",
    "home_value": """select p_partkey as zip, p_retailprice as m2008_01,
        p_retailprice * 1.5E0 as m2008_02, cast(null as double) as m2007_12 from part""",
    "zip_area": """select n_nationkey as zip, 32.5E0 + (n_nationkey % 5) * 0.2E0 as y0,
        32.5E0 + (n_nationkey % 5) * 0.2E0 + 0.2E0 as y1,
        -117.3E0 + cast(floor(n_nationkey / 5.0E0) as int) * 0.2E0 as x0,
        -117.3E0 + cast(floor(n_nationkey / 5.0E0) as int) * 0.2E0 + 0.2E0 as x1 from nation""",
}


def _used(text: str) -> list[str]:
    return [name for name in VIEW_SQL if re.search(rf"\b{name}\b", text)]


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of every view it names."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for dependency in _used(VIEW_SQL[name]):
            if dependency != name:
                visit(dependency)
        if name not in wanted:
            wanted.append(name)

    for name in _used(body):
        visit(name)
    ctes = [f"{name} as ({VIEW_SQL[name]})" for name in wanted]
    body = body.strip()
    if body[:5].lower() == "with ":
        if not ctes:
            return body
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body
