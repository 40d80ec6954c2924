"""Date and time column expressions. Timestamps carry no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_bucket(ts: Column, minutes: int) -> Column:
    """Round to the nearest bucket of the hour, ties to the even bucket.

    23:45 and later may land on the next day for 30-minute buckets.
    """
    steps = F.bround(F.minute(ts) / F.lit(float(minutes)))
    return hour_floor(ts) + F.make_dt_interval(mins=(steps * minutes).cast("int"))


def bucket_floor(ts: Column, minutes: int) -> Column:
    """Start of the bucket of the hour that holds ``ts``."""
    return hour_floor(ts) + F.make_dt_interval(
        mins=(F.floor(F.minute(ts) / F.lit(float(minutes))) * minutes).cast("int"))


def hour_floor(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def day_slot(ts: Column, minutes: int = 5) -> Column:
    """Zero-based slot of the day."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / F.lit(float(minutes))).cast("int")


def date_of_year_day(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def from_parts(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Timestamp from parts; hour 24 is midnight of the next day."""
    return F.make_date(year, month, day).cast("timestamp_ntz") + F.make_dt_interval(hours=hour)


def feed_time(text: Column) -> Column:
    """``MM/dd/yyyy HH:mm:ss`` to a zone-less timestamp, null when malformed."""
    # Rearranged to ISO text, so that no session time zone takes part.
    shape = r"^([0-9]{2})/([0-9]{2})/([0-9]{4}) ([0-9]{2}:[0-9]{2}:[0-9]{2})$"
    iso = F.regexp_replace(text, shape, "$3-$1-$2 $4")
    return F.when(text.rlike(shape), iso.try_cast("timestamp_ntz"))


def wall_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 on the wall clock; no session zone takes part."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def monday_zero(day: Column) -> Column:
    """Weekday with Monday = 0."""
    return F.weekday(day)
