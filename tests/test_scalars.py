"""Hand-written rows for the semantic traps."""

import datetime as dt

from pyspark.sql import functions as F

from loopweave.functions import calendar, geo, scalars, vectors
from loopweave.schemas import DIRECTION_FROM_ONE, DIRECTION_FROM_ZERO


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def test_nearest_half_hour_ties_to_even_and_rolls_over(spark):
    assert one(spark, calendar.nearest_bucket(ntz("2010-01-13 07:15:00"), 30)) == dt.datetime(
        2010, 1, 13, 7)
    assert one(spark, calendar.nearest_bucket(ntz("2010-01-13 07:45:00"), 30)) == dt.datetime(
        2010, 1, 13, 8)
    assert one(spark, calendar.nearest_bucket(ntz("2010-01-13 23:45:00"), 30)) == dt.datetime(
        2010, 1, 14)


def test_bucket_floor(spark):
    assert one(spark, calendar.bucket_floor(ntz("2010-01-13 07:59:59"), 15)) == dt.datetime(
        2010, 1, 13, 7, 45)


def test_weekdays(spark):
    sunday = F.lit("2010-01-03").cast("date")
    assert one(spark, F.dayofweek(sunday)) == 1
    assert one(spark, calendar.monday_zero(sunday)) == 6
    assert one(spark, calendar.is_weekend(sunday)) is True


def test_year_day(spark):
    day = calendar.date_of_year_day
    assert one(spark, day(F.lit(2008), F.lit(60))) == dt.date(2008, 2, 29)
    assert one(spark, day(F.lit(2009), F.lit(60))) == dt.date(2009, 3, 1)


def test_hour_24_is_next_midnight(spark):
    value = calendar.from_parts(F.lit(2010), F.lit(1), F.lit(31), F.lit(24))
    assert one(spark, value) == dt.datetime(2010, 2, 1)


def test_feed_time_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        # 02:30 does not exist on this day in that zone.
        assert one(spark, calendar.feed_time(F.lit("03/14/2010 02:30:00"))) == dt.datetime(
            2010, 3, 14, 2, 30)
        seconds = [one(spark, calendar.wall_seconds(ntz(f"2010-03-14 0{h}:30:00")))
                   for h in (1, 2, 3)]
        assert [b - a for a, b in zip(seconds, seconds[1:])] == [3600, 3600]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert one(spark, calendar.feed_time(F.lit("2010-03-14"))) is None
    assert one(spark, calendar.feed_time(F.lit("13/45/2010 02:30:00"))) is None


def test_postmile(rows):
    df = rows("x string", [("R12.5",), ("12.5",), ("1.2.3",), ("R",), (None,), ("-.5",)])
    got = [r[0] for r in df.select(scalars.postmile(F.col("x"))).collect()]
    assert got == [12.5, 12.5, 2.3, 0.0, 0.0, -0.5]


def test_date_in_path(spark):
    assert one(spark, scalars.date_in_path(F.lit("/a/d11_text_meta_2010_01_13.txt"))) == dt.date(
        2010, 1, 13)
    assert one(spark, scalars.date_in_path(F.lit("/a/other.txt"))) is None


def test_incident_code(rows):
    df = rows("x string", [("1179-Traffic Collision - A",), ("CLOSURE of a Road",), ("Other",)])
    got = [tuple(r) for r in df.select(scalars.incident_code(F.col("x")),
                                       scalars.incident_text(F.col("x"))).collect()]
    assert got == [("1179", "Traffic Collision - A"), ("1", "CLOSURE of a Road"), (None, "Other")]


def test_decimal_degrees(spark):
    value = scalars.decimal_degrees(F.lit(117), F.lit(30), F.lit(36), F.lit("-"))
    assert abs(one(spark, value) + 117.51) < 1e-9


def test_direction_codes(rows):
    df = rows("d string", [("N",), ("E",), ("S",), ("W",), ("X",)])
    got = [tuple(r) for r in df.select(
        scalars.direction_code(F.col("d"), DIRECTION_FROM_ONE),
        scalars.direction_code(F.col("d"), DIRECTION_FROM_ZERO)).collect()]
    assert got == [(1, 0), (3, 1), (2, 2), (4, 3), (-1, -1)]


def test_ring_containment_handles_concave_shapes(rows):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    points = [(1.0, 1.0, True), (2.0, 2.0, False), (3.5, 2.0, True), (5.0, 1.0, False)]
    df = rows("x double, y double, want boolean, ring array<struct<x:double,y:double>>",
              [(*p, ring) for p in points])
    for row in df.withColumn("got", geo.inside_ring(F.col("x"), F.col("y"),
                                                    F.col("ring"))).collect():
        assert row["got"] == row["want"]


def test_distance_of_a_degree(spark):
    metres = geo.distance_m(F.lit(32.0), F.lit(-117.0), F.lit(33.0), F.lit(-117.0))
    assert abs(one(spark, metres) - geo.METRES_PER_DEGREE) < 1e-3


def test_vector_expressions(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))
    assert one(spark, vectors.dot(a, b)) == 13.0
    assert one(spark, vectors.mse(a, b)) == 6.5
    assert one(spark, vectors.mean(b)) == 4.0
