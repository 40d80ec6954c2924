"""Streaming forms of the feed jobs: new files, windows, duplicates, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def arriving_files(spark: SparkSession, folder: str, schema: T.StructType | str,
                   fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files in a folder; the checkpoint remembers which were read."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is available now to a Parquet table, then stop."""
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def drain_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed rows of every batch under its batch number.

    A repeated batch overwrites its own folder, so retries leave no copies.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (stream.writeStream.outputMode("update").foreachBatch(save)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key that ``drain_updates`` wrote.

    An aggregate, so the versions of a key combine before the shuffle.
    """
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*kept), "batch").alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def event_time(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Add ``_event_time`` with its watermark."""
    # Watermarks need an instant. In a zone whose clocks change, local times near a
    # change would move to another window, so only UTC is accepted.
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"streams need the session time zone UTC, not {zone}")
    return stream.withColumn("_event_time", F.col(time).cast("timestamp")).withWatermark(
        "_event_time", late)


def window_averages(stream: DataFrame, time: str = "time", keys: list[str] | None = None,
                    span: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling averages of speed and flow. Windows start on the floor of the time,
    unlike the batch buckets, which round to the nearest."""
    keys = keys or ["station_id"]
    return (event_time(stream, time, late)
            .groupBy(F.window("_event_time", span), *keys)
            .agg(F.count("*").alias("n"), F.avg("avg_speed").alias("avg_speed"),
                 F.avg("total_flow").alias("total_flow"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, "n",
                    "avg_speed", "total_flow"))


def without_duplicates(stream: DataFrame, keys: list[str], time: str = "time",
                       late: str = "1 hour") -> DataFrame:
    """The first row of every key that arrives within the lateness bound."""
    return (event_time(stream, time, late).dropDuplicatesWithinWatermark(keys)
            .drop("_event_time"))


def with_station_version(stream: DataFrame, history: DataFrame, key: str = "station_id",
                         time: str = "time", default: int = -1) -> DataFrame:
    """Attach the station version valid on the day of each reading; the history is static."""
    versions = history.select(F.col("sensor_id").alias("_sensor"), F.col("eff_start").alias("_from"),
                              F.col("eff_end").alias("_to"), F.col("id").alias("_id"))
    day = F.to_date(time)
    valid = ((F.col(key) == F.col("_sensor")) & (F.col("_from") <= day)
             & (F.col("_to").isNull() | (day < F.col("_to"))))
    return stream.join(versions, valid, "left").select(
        *stream.columns, F.coalesce("_id", F.lit(default)).alias("station_version"))
