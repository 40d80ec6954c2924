"""The star schema as a published folder of Parquet tables, opened as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loopweave.functions.sql import register_functions, register_views
from loopweave.sources import published

# Tables that grow without bound, and what they are laid out by.
LAYOUT = {"observation": "day", "lane_observation": "day", "incident": "year",
          "precipitation_hourly": "year", "precipitation_daily": "year", "profiles": "year"}


def save_star(tables: dict[str, DataFrame], folder: str) -> None:
    """Publish all tables together; facts that carry their layout column are partitioned by it.

    Facts are written in ranges of (layout, first column): each partition gets
    few files, and a hot day is split over several tasks. If one table fails, the
    star stays as it was.
    """
    spark = next(iter(tables.values())).sparkSession
    after, made = published.version(spark, folder), {}
    for name, df in tables.items():
        layout = LAYOUT.get(name)
        if layout in df.columns:
            spread = next(c for c in df.columns if c != layout)
            writer = df.repartitionByRange(layout, spread).write.partitionBy(layout)
        else:
            writer = df.write
        path = published.aside(folder)
        writer.parquet(path)
        made[name] = published.Stored(df.schema.jsonValue(), {published.WHOLE: path})
    published.publish(spark, folder, made, after)


def open_star(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Register the named tables and the SQL functions; returns the tables."""
    current = published.version(spark, folder)
    tables = {name: published.read(spark, folder, name, current) for name in names}
    register_views(tables)
    register_functions(spark)
    return tables
