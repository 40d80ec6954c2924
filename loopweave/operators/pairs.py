"""Pairs of groups with close values in the same time bucket."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_pairs(readings: DataFrame, bucket: str, group: list[str], value: str,
                  tolerance: float = 0.1) -> DataFrame:
    """Distinct group pairs (a, b) with some bucket where b's value is within
    ``a * (1 - tolerance)`` and ``a * (1 + tolerance)``.

    Values fall into cells of a logarithmic scale whose width is half the
    tolerance. Only the smallest and largest value per (bucket, group, cell)
    matter: values of one cell always match each other, and between different
    cells the closest two decide. So the join sees one row per group and cell,
    never the readings, and runs on (bucket, cell) equality. Zero matches zero;
    negative values match nothing.
    """
    step = math.log1p(tolerance) / 2
    down = math.ceil(-math.log1p(-tolerance) / step) + 1
    up = math.ceil(math.log1p(tolerance) / step) + 1
    zero = -(10 ** 9)
    # log of a zero is never asked for: the inner when turns it into null.
    cell = (F.when(F.col("_v") == 0, F.lit(zero))
            .otherwise(F.floor(F.log(F.when(F.col("_v") > 0, F.col("_v"))) / F.lit(step)))
            .cast("int"))
    extremes = (readings.filter(F.col(value) >= 0)
                .select(F.col(bucket).alias("_bucket"), *group, F.col(value).alias("_v"))
                .withColumn("_cell", cell)
                # Stated for both sides of the self-join, so that they share one shuffle.
                .filter(F.col("_cell").isNotNull())
                .groupBy("_bucket", *group, "_cell")
                .agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    reach = F.when(F.col("_cell") == zero, F.array(F.lit(zero))).otherwise(
        F.sequence(F.col("_cell") - down, F.col("_cell") + up))
    left = extremes.select("_bucket", *[F.col(g).alias(f"{g}_1") for g in group],
                           F.col("_cell").alias("_own"), F.col("_low").alias("_low_1"),
                           F.col("_high").alias("_high_1"), F.explode(reach).alias("_cell"))
    right = extremes.select("_bucket", *[F.col(g).alias(f"{g}_2") for g in group], "_cell",
                            F.col("_low").alias("_low_2"), F.col("_high").alias("_high_2"))
    close = (F.when(F.col("_cell") == F.col("_own"), F.lit(True))
             .when(F.col("_cell") > F.col("_own"),
                   F.col("_low_2") <= F.col("_high_1") * F.lit(1 + tolerance))
             .otherwise(F.col("_high_2") >= F.col("_low_1") * F.lit(1 - tolerance)))
    return (left.join(right, ["_bucket", "_cell"]).filter(close)
            .select(*[f"{g}_1" for g in group], *[f"{g}_2" for g in group]).distinct())
