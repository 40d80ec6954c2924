"""SQL functions and views, for those who write their questions as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Bodies are plain expressions, so Catalyst inlines them; no Python is called.
_NEAREST = ("cast(to_date(ts) as timestamp_ntz) + make_dt_interval(0, hour(ts)) + "
            "make_dt_interval(0, 0, cast(bround(minute(ts) / {n}D) * {n} as int))")

SQL_FUNCTIONS = {
    "round_30m": ("ts timestamp_ntz", "timestamp_ntz", _NEAREST.format(n=30)),
    "round_15m": ("ts timestamp_ntz", "timestamp_ntz", _NEAREST.format(n=15)),
    "year_doy_to_date": ("y int, doy int", "date", "date_add(make_date(y, 1, 1), doy - 1)"),
    "distance_m": (
        "lat1 double, lon1 double, lat2 double, lon2 double", "double",
        "case when lat1 + lon1 + lat2 + lon2 is not null then 2 * 6371008.8D * asin(sqrt(least(1D, "
        "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * "
        "pow(sin(radians(lon2 - lon1) / 2), 2)))) end"),
}


def register_functions(spark: SparkSession) -> None:
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) "
                  f"returns {result} return {body}")


def register_views(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
