"""Station-day profiles from readings to components and station averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.functions import calendar
from loopweave.operators import aggregates, projection, reshape
from loopweave.schemas import DIRECTION_FROM_ONE, MEASURES, PROFILE_KEYS
from loopweave.functions.scalars import direction_code
from loopweave.session import staged


def station_days(readings: DataFrame, lane_type: str = "ML", minutes: int = 5,
                 strict: bool = True, measures: list[str] | None = None,
                 how: str = "first") -> DataFrame:
    """Readings of the feed to one profile per station and day, with all six keys.

    Expects the columns of ``read_station_5min``; the lane-type filter runs
    before the shuffle.
    """
    time = F.col("time")
    named = readings.filter(F.col("lane_type") == lane_type).select(
        F.col("station").cast("int").alias("station_id"), F.col("district").alias("district_id"),
        F.year(time).alias("year"), F.dayofyear(time).alias("day_of_year"),
        F.dayofweek(time).alias("day_of_week"),
        direction_code(F.col("direction"), DIRECTION_FROM_ONE).alias("direction"), "time",
        calendar.day_slot(time, minutes).alias("slot"), "total_flow",
        F.col("avg_occupancy").alias("occupancy"), F.col("avg_speed").alias("speed"),
        "bad_reading")
    return reshape.slot_profiles(named, PROFILE_KEYS, "slot", measures or MEASURES,
                                 slots=1440 // minutes, how=how, strict=strict, time="time",
                                 bad="bad_reading")


def day_parts() -> dict:
    weekend = F.col("day_of_week").isin(1, 7)
    return {"weekday": ~weekend, "weekend": weekend}


def station_profiles(profiles: DataFrame, k: int, measure: str = "total_flow",
                     basis: str | None = None) -> tuple[dict, DataFrame]:
    """Bases per day part, and average coefficients per station and direction.

    The profiles are staged as columns, so that the feed behind them is read and
    pivoted once, and each pass reads the keys and one measure.
    """
    profiles = staged(profiles.select(*PROFILE_KEYS, measure), "profiles")
    parts = day_parts()
    bases = projection.fit_parts(profiles, measure, parts, k)
    projected = projection.transform_parts(profiles, measure, parts, bases, PROFILE_KEYS, basis)
    averaged = projected.groupBy("part", "station_id", "direction").agg(
        *[F.avg(f"V{i}").alias(f"V{i}") for i in range(k)])
    return bases, averaged


def yearly_summary(profiles: DataFrame, measure: str = "total_flow") -> DataFrame:
    """Mean profile and cumulative share of variance by slot, per year and day part."""
    part = F.when(F.col("day_of_week").isin(1, 7), "weekend").otherwise("weekday")
    keyed = profiles.withColumn("part", part)
    keys = ["year", "part"]
    slots = aggregates.per_slot(aggregates.vector_moments(keyed, measure, keys), keys)
    whole = slots.groupBy(*keys).agg(F.sum("variance").alias("_all"))
    ratios = slots.join(whole, keys).withColumn("ratio", F.try_divide("variance", "_all"))
    return aggregates.cumulative_share(ratios, "slot", "ratio", keys).drop("_all")
