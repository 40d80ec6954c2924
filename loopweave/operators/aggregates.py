"""Grouped averages, shares, histograms and most-common values."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.functions import calendar


def bucket_averages(readings: DataFrame, minutes: int, station: str = "station_id",
                    time: str = "time", value: str = "avg_speed",
                    use: Column | None = None) -> DataFrame:
    """Average per station and nearest bucket; ``use`` limits the readings."""
    rows = readings if use is None else readings.filter(use)
    return (rows.groupBy(F.col(station).alias("station_id"),
                         calendar.nearest_bucket(F.col(time), minutes).alias("bucket"))
            .agg(F.avg(value).alias("bucket_avg")).filter(F.col("bucket_avg").isNotNull()))


def day_averages(readings: DataFrame, station: str = "station_id", time: str = "time",
                 value: str = "avg_speed") -> DataFrame:
    return readings.groupBy(F.col(station).alias("station_id"), F.to_date(time).alias("day")).agg(
        F.avg(value).alias("day_avg"))


def dips_below_day(readings: DataFrame, minutes: int, share: float = 0.4,
                   station: str = "station_id", time: str = "time", value: str = "avg_speed",
                   use: Column | None = None) -> DataFrame:
    """Buckets whose average is under ``share`` of the station's average that day.

    The day is that of the rounded bucket, the day average takes the readings of
    the calendar day. Every reading counts towards its bucket (if ``use`` holds)
    and towards its day in one aggregation, so the readings are scanned once
    and no join follows: per station and day, the window sees one row per
    bucket and one for the day.
    """
    bucket = calendar.nearest_bucket(F.col(time), minutes)
    rows = readings.select(
        F.col(station).alias("station_id"), F.col(value).alias("_v"),
        (F.lit(True) if use is None else use).alias("_use"), bucket.alias("_bucket"),
        F.to_date(time).alias("_day"))
    keyed = rows.select("station_id", "_v", "_use", F.inline(F.array(
        F.struct(F.to_date("_bucket").alias("day"), F.col("_bucket").alias("bucket")),
        F.struct(F.col("_day").alias("day"), F.lit(None).cast("timestamp_ntz").alias("bucket")))))
    counted = F.when(F.col("bucket").isNull() | F.col("_use"), F.col("_v"))
    averages = keyed.groupBy("station_id", "day", "bucket").agg(F.avg(counted).alias("bucket_avg"))
    whole = Window.partitionBy("station_id", "day")
    day_avg = F.max(F.when(F.col("bucket").isNull(), F.col("bucket_avg"))).over(whole)
    return (averages.withColumn("day_avg", day_avg)
            .filter(F.col("bucket").isNotNull()
                    & (F.col("bucket_avg") < F.lit(share) * F.col("day_avg"))))


def label_shares(df: DataFrame, label: str) -> DataFrame:
    """Rows per label and their share of all rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / counts.agg(F.sum("n")).scalar())


def vector_moments(df: DataFrame, vector: str, keys: list[str] | None = None) -> DataFrame:
    """Element-wise mean, sample variance and standard deviation arrays, per key.

    One aggregation with mergeable buffers, whatever the number of keys.
    """
    packed = df.select(*(keys or []), array_to_vector(F.col(vector).cast("array<double>"))
                       .alias("_x"))
    metrics = Summarizer.metrics("mean", "variance", "std", "count").summary(F.col("_x"))
    return (packed.groupBy(*(keys or [])).agg(metrics.alias("_m"))
            .select(*(keys or []), F.col("_m.count").alias("n"),
                    vector_to_array("_m.mean").alias("mean"),
                    vector_to_array("_m.variance").alias("variance"),
                    vector_to_array("_m.std").alias("std")))


def per_slot(moments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Moment arrays to one row per slot, with a one-deviation band."""
    zipped = F.arrays_zip("mean", "variance", "std")
    return (moments.select(*(keys or []), F.posexplode(zipped).alias("slot", "_m"))
            .select(*(keys or []), "slot", "_m.mean", "_m.variance", "_m.std",
                    (F.col("_m.mean") - F.col("_m.std")).alias("lower"),
                    (F.col("_m.mean") + F.col("_m.std")).alias("upper")))


def most_common(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The most frequent value tuple per key; ties go to the smallest tuple.

    Counts collapse before the choice, so the choice sees one row per distinct
    tuple, and both steps combine on the map side.
    """
    counts = df.groupBy(*keys, *values).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("_minus_n"), *values))
    return (counts.groupBy(*keys).agg(best.alias("_b"))
            .select(*keys, *[F.col(f"_b.{v}").alias(v) for v in values],
                    (-F.col("_b._minus_n")).alias("n")))


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the upper edge belongs to the last bin.

    Where all values are equal, they lie in bin 0.
    """
    inside = F.least(F.lit(bins - 1), F.floor(F.try_divide(value - low, high - low) * bins))
    return F.when(high == low, F.when(value.isNotNull(), 0)).otherwise(
        F.when(value.isNotNull(), inside)).cast("int")


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """Counts per non-empty cell of an equal-width grid over the data range."""
    edges = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"),
                            F.max(y).alias("y1"))).scalar()
    return (df.select(bin_number(F.col(x), edges["x0"], edges["x1"], bins).alias("bin_x"),
                      bin_number(F.col(y), edges["y0"], edges["y1"], bins).alias("bin_y"))
        .groupBy("bin_x", "bin_y").agg(F.count("*").alias("n")))


def cumulative_share(ratios: DataFrame, index: str, ratio: str,
                     keys: list[str] | None = None) -> DataFrame:
    """Running sum of component ratios; one row per component and key group."""
    frame = (Window.partitionBy(*(keys or [])).orderBy(index)
             .rowsBetween(Window.unboundedPreceding, 0))
    return ratios.withColumn("cumulative", F.sum(ratio).over(frame))


def rain_comparison(observations: DataFrame, precipitation: DataFrame, stations: DataFrame,
                    days: list[str], value: str = "total_flow") -> DataFrame:
    """Average value on rainy and on dry days of the list, and dry minus rainy per day.

    A day is rainy when any of the given weather stations measured rain.
    """
    listed = [F.lit(d).cast("date") for d in days]
    rainy = (precipitation.filter(F.col("day").isin(*listed) & (F.col("amount") > 0))
             .join(stations.select(F.col("id").alias("station_id")), "station_id", "left_semi")
             .select("day").distinct())
    per_day = (observations.select(F.to_date("time").alias("day"), value)
               .filter(F.col("day").isin(*listed))
               .groupBy("day").agg(F.sum(value).alias("_s"), F.count(value).alias("_n")))
    flagged = per_day.join(rainy.withColumn("_rain", F.lit(True)), "day", "left")
    wet = F.col("_rain").isNotNull()

    def average(flag):
        return F.sum(F.when(flag, F.col("_s"))) / F.nullif(F.sum(F.when(flag, F.col("_n"))),
                                                          F.lit(0))

    return (flagged.agg(average(wet).alias("rainy_avg"), average(~wet).alias("dry_avg"),
                        F.count(F.when(wet, 1)).alias("rainy_days"),
                        F.count(F.when(~wet, 1)).alias("dry_days"))
            .withColumn("delta_per_day", (F.col("dry_avg") - F.col("rainy_avg")) * 288.0))
