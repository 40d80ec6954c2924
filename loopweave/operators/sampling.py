"""Repeatable samples by key hash: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_text(*keys: str, salt: str = "") -> Column:
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in keys]))


def below(fraction: float, *keys: str, salt: str = "") -> Column:
    """True for ``fraction`` of all key hashes: none at 0, every one at 1."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    digits = F.conv(F.substring(hash_text(*keys, salt=salt), 1, 8), 16, 10).cast("long")
    return digits < F.lit(int(fraction * 16 ** 8))


def hash_fraction(df: DataFrame, keys: list[str], fraction: float, salt: str = "") -> DataFrame:
    """About ``fraction`` of the rows; a pure filter."""
    return df.filter(below(fraction, *keys, salt=salt))


def hash_split(df: DataFrame, keys: list[str], fraction: float,
               salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Two complementary filters, about ``fraction`` and the rest."""
    head = below(fraction, *keys, salt=salt)
    return df.filter(head), df.filter(~head)


def hash_first(df: DataFrame, keys: list[str], n: int, salt: str = "") -> DataFrame:
    """The ``n`` rows with the smallest key hash."""
    return (df.withColumn("_h", hash_text(*keys, salt=salt)).orderBy("_h", *keys).limit(n)
            .drop("_h"))


def share_per_group(df: DataFrame, group: str, keys: list[str], share: float, salt: str = "",
                    prefix: int = 2) -> DataFrame:
    """``ceil(share * size)`` rows of every group, in key-hash order.

    Ranks are built from two levels, so a hot group is spread over
    16**prefix hash ranges: counts per range give offsets, and only ranges that
    start below the quota are ranked at all.
    """
    tagged = (df.withColumn("_h", hash_text(*keys, salt=salt))
              .withColumn("_range", F.substring("_h", 1, prefix)))
    counts = tagged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(group).orderBy("_range")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(group)
    offsets = (counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .withColumn("_quota", F.ceil(F.sum("_n").over(whole) * F.lit(share)))
               .filter(F.col("_offset") < F.col("_quota")).drop("_n"))
    inside = Window.partitionBy(group, "_range").orderBy("_h", *keys)
    return (tagged.join(offsets, [group, "_range"])
            .withColumn("_rank", F.row_number().over(inside) + F.col("_offset"))
            .filter(F.col("_rank") <= F.col("_quota"))
            .select(*df.columns, F.col("_rank").alias("sample_rank")))
