"""One key holds a third of all rows: results stay whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loopweave.operators import aggregates, dimensions, reshape, sampling

N = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Readings of 500 stations over ten days; station 0 sends a third of them."""
    key = F.col("id")
    station = F.when(key % 3 == 0, 0).otherwise(key % 500)
    seconds = (key * 7919 % 864_000).cast("int")
    return spark.range(N).select(
        key, station.alias("station_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast(
            "decimal(18,6)"))).alias("time"),
        ((key * 31) % 97).cast("double").alias("avg_speed")).repartition(12)


@pytest.fixture
def split_skew(spark):
    """Make AQE treat the hot station as skewed at this size."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_version_join_splits_the_hot_station(spark, skewed, split_skew):
    starts = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in (0, 3, 6)]
    versions = spark.createDataFrame([(s, d, i) for s in range(500) for i, d in enumerate(starts)],
                                     "sensor long, d date, n int")
    history = dimensions.numbered_history(versions, "sensor", "d")
    joined = dimensions.version_at(skewed.withColumn("day", F.to_date("time")), history,
                                   "station_id", "day", "sensor", start="d")
    want = F.col("station_id") * 3 + F.when(F.col("day") < starts[1], 1).when(
        F.col("day") < starts[2], 2).otherwise(3)
    got = joined.agg(F.count("*"), F.sum((F.col("station_version") != want).cast("int"))).first()
    assert tuple(got) == (N, 0)
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_dips_and_profiles_of_the_hot_station(skewed):
    local = skewed.toPandas()
    local["day"] = local["time"].dt.date
    local["bucket"] = local["time"].dt.floor("h") + (
        (local["time"].dt.minute / 30).round() * 30).astype(int).map(lambda m: dt.timedelta(minutes=m))
    buckets = local.groupby(["station_id", "bucket"])["avg_speed"].mean().reset_index()
    buckets["day"] = buckets["bucket"].dt.date
    days = local.groupby(["station_id", "day"])["avg_speed"].mean().rename("d").reset_index()
    both = buckets.merge(days, on=["station_id", "day"])
    want = int((both["avg_speed"] < 0.4 * both["d"]).sum())
    assert aggregates.dips_below_day(skewed, 30).count() == want

    slots = skewed.withColumn("day", F.to_date("time")).withColumn("slot", F.hour("time"))
    profiles = reshape.slot_profiles(slots, ["station_id", "day"], "slot", ["avg_speed"], slots=24,
                                     strict=False)
    total = profiles.agg(F.sum(F.expr("aggregate(avg_speed, 0D, (a, x) -> a + x)"))).first()[0]
    local["hour"] = local["time"].dt.hour
    assert total == local.groupby(["station_id", "day", "hour"])["avg_speed"].max().sum()


def test_first_rows_and_samples_of_the_hot_station(skewed):
    first = dimensions.first_per_key(skewed.select("station_id", "id"), ["station_id"], ["id"])
    got = {r["station_id"]: r["id"] for r in first.collect()}
    assert got[0] == 0 and len(got) == 500
    taken = sampling.share_per_group(skewed, "station_id", ["id"], 0.05)
    sizes = {r[0]: r[1] for r in skewed.groupBy("station_id").count().collect()}
    counts = {r[0]: r[1] for r in taken.groupBy("station_id").count().collect()}
    assert counts == {k: -(-n * 5 // 100) for k, n in sizes.items()}
