"""Named analytical questions over observations, stations, freeways and weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.operators import aggregates, pairs, spatial


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def week_averages(observations: DataFrame, stations: DataFrame, week_one: str,
                  week_two: str) -> DataFrame:
    """Average speed per station in two weeks that start on the given days.

    One conditional pass over the readings, grouped before the station join.
    Stations without positive averages in both weeks drop out.
    """
    def span(start):
        return _at(start), _at(start) + F.expr("interval '6 23:59:59' day to second")

    first, second = (F.col("time").between(*span(s)) for s in (week_one, week_two))
    speeds = (observations.filter(first | second).groupBy("station_id")
              .agg(F.avg(F.when(first, F.col("avg_speed"))).alias("week_one"),
                   F.avg(F.when(second, F.col("avg_speed"))).alias("week_two"))
              .filter((F.col("week_one") > 0) & (F.col("week_two") > 0)))
    return (speeds.join(stations.select(F.col("id").alias("station_id"), "name"), "station_id")
            .select("station_id", "name", "week_one", "week_two"))


def largest_speed_change(observations, stations, week_one, week_two) -> DataFrame:
    """The station whose average speed rose most between the two weeks."""
    weeks = week_averages(observations, stations, week_one, week_two)
    delta = F.col("week_two") - F.col("week_one")
    return weeks.withColumn("delta", delta).orderBy(F.desc("delta"), "station_id").limit(1)


def rainy_day_throughput(observations, precipitation, weather_stations, days, latitude, longitude,
                         miles: float = 15, value: str = "total_flow") -> DataFrame:
    """Flow on rainy against dry days, by rain gauges around one place."""
    near = spatial.within(weather_stations, latitude, longitude, miles * 1852)
    return aggregates.rain_comparison(observations, precipitation, near, days, value)


def incidents_per_day(incidents: DataFrame, weeks: list[tuple[str, str]],
                      codes: list[str] | None = None) -> DataFrame:
    """Incidents per calendar day inside each span, all or of some codes."""
    from loopweave.functions.scalars import incident_code

    day = F.to_date("time")
    week = F.lit(None).cast("int")
    for number, (first, last) in reversed(list(enumerate(weeks, start=1))):
        week = F.when(F.col("time").between(_at(first), _at(last)), number).otherwise(week)
    rows = incidents.withColumn("week", week).filter(F.col("week").isNotNull())
    if codes:
        rows = rows.filter(incident_code(F.col("description")).isin(*codes))
    return rows.groupBy("week", day.alias("day")).agg(F.count("*").alias("n"))


def freeway_speeds(observations: DataFrame, stations: DataFrame, freeways: DataFrame,
                   hours: tuple[int, int] | None = None,
                   between: tuple[str, str] | None = None) -> DataFrame:
    """Average positive speed per freeway and direction, optionally by hour of day and time.

    Readings collapse to one row per station before any join.
    """
    rows = observations.filter(F.col("avg_speed") > 0)
    if hours:
        rows = rows.filter(F.hour("time").between(*hours))
    if between:
        rows = rows.filter(F.col("time").between(_at(between[0]), _at(between[1])))
    per_station = rows.groupBy("station_id").agg(F.sum("avg_speed").alias("_s"),
                                                 F.count("avg_speed").alias("_n"))
    return (per_station
            .join(stations.select(F.col("id").alias("station_id"), "fwy_id"), "station_id")
            .join(freeways.select(F.col("id").alias("fwy_id"), "num", "direction"), "fwy_id")
            .groupBy("num", "direction")
            .agg((F.sum("_s") / F.sum("_n")).alias("avg_speed")))


def fastest_and_slowest(observations, stations, freeways, hours=(15, 19), between=None,
                        n: int = 5) -> DataFrame:
    """The n fastest and the n slowest freeways."""
    speeds = freeway_speeds(observations, stations, freeways, hours, between)
    fast = speeds.orderBy(F.desc("avg_speed"), "num", "direction").limit(n)
    slow = speeds.orderBy("avg_speed", "num", "direction").limit(n)
    return (fast.withColumn("kind", F.lit("fastest"))
            .unionByName(slow.withColumn("kind", F.lit("slowest"))))


def slow_intervals(observations, stations, freeways, types, num: int, direction: str,
                   between: tuple[str, str], below: float = 45, minutes: int = 30,
                   lane_type: str = "ML") -> DataFrame:
    """Slow half hours of one freeway direction with their average flow and speed."""
    from loopweave.functions.calendar import nearest_bucket

    chosen = (stations
              .join(freeways.filter((F.col("num") == num) & (F.col("direction") == direction))
                    .select(F.col("id").alias("fwy_id")), "fwy_id", "left_semi")
              .join(types.filter(F.col("type") == lane_type).select(F.col("id").alias("type_id")),
                    "type_id", "left_semi")
              .select(F.col("id").alias("station_id"), "name", "latitude"))
    rows = observations.filter(F.col("time").between(_at(between[0]), _at(between[1])))
    averages = (rows.groupBy("station_id", nearest_bucket(F.col("time"), minutes).alias("bucket"))
                .agg(F.avg("total_flow").alias("avg_flow"), F.avg("avg_speed").alias("avg_speed"))
                .filter(F.col("avg_speed") < below))
    return (averages.join(chosen, "station_id")
            .select("name", "latitude", "bucket", "avg_flow", "avg_speed")
            .orderBy("bucket", "latitude", "name"))


def freeway_dips(observations, stations, freeways, minutes: int = 30,
                 share: float = 0.4) -> DataFrame:
    """Freeways with a bucket below a share of that station's day average."""
    dips = aggregates.dips_below_day(observations, minutes, share)
    return (_with_freeway(dips.select("station_id", "bucket"), stations, freeways)
            .select("num", "direction", "bucket").distinct())


def _with_freeway(rows: DataFrame, stations: DataFrame, freeways: DataFrame) -> DataFrame:
    return (rows.join(stations.select(F.col("id").alias("station_id"), "fwy_id"), "station_id")
            .join(freeways.select(F.col("id").alias("fwy_id"), "num", "direction"), "fwy_id"))


def similar_freeways(observations, stations, freeways, numbers: list[int] | None = None,
                     minutes: int = 15, share: float = 0.4, tolerance: float = 0.1,
                     type_id: int | None = None) -> DataFrame:
    """Freeway pairs whose congested buckets have speeds within a tolerance."""
    if numbers:
        wanted = freeways.filter(F.col("num").isin(*numbers)).select(F.col("id").alias("fwy_id"))
        stations = stations.join(wanted, "fwy_id", "left_semi")
    if type_id is not None:
        stations = stations.filter(F.col("type_id") == type_id)
    if numbers or type_id is not None:
        ids = stations.select(F.col("id").alias("station_id"))
        observations = observations.join(ids, "station_id", "left_semi")
    congested = aggregates.dips_below_day(observations, minutes, share, use=F.col("samples") != 0)
    dips = _with_freeway(congested, stations, freeways)
    return pairs.similar_pairs(dips, "bucket", ["num", "direction"], "bucket_avg", tolerance)


def missing_coefficients(rows: DataFrame, year: str, day: str, coefficient: str) -> DataFrame:
    """Weekday rows whose coefficients are missing."""
    from loopweave.functions.calendar import date_of_year_day, is_weekend

    date = date_of_year_day(F.col(year), F.col(day))
    return rows.filter(~is_weekend(date) & F.col(coefficient).isNull()).agg(
        F.count("*").alias("n"))


def collisions(incidents: DataFrame, codes: list[str]) -> DataFrame:
    """The incidents that are collisions."""
    from loopweave.functions.scalars import incident_code

    return incidents.filter(incident_code(F.col("description")).isin(*codes))


def incident_points(incidents: DataFrame, freeways: DataFrame,
                    weeks: list[tuple[str, str]] | None = None,
                    codes: list[str] | None = None) -> DataFrame:
    """Map markers (lat, lon, time, text, freeway), all, of some codes, or by week."""
    rows = collisions(incidents, codes) if codes else incidents
    if weeks:
        inside = F.lit(False)
        for first, last in weeks:
            inside = inside | F.col("time").between(_at(first), _at(last))
        rows = rows.filter(inside)
    return (rows.join(freeways.select(F.col("id").alias("fwy_id"), "num", "direction"), "fwy_id")
            .select("id", "latitude", "longitude", "time", "description", "num", "direction"))
