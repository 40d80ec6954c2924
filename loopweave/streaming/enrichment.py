"""Readings enriched by a history that changes while they arrive.

Readings and station versions are two streams of files. Both are keyed by a bucket of
sensors: their versions are state, and so are their readings of the last ``horizon``. A
reading is answered at once, with the version valid on its day or with -1. When a
version arrives later, the kept readings are looked up again, and those whose answer
changed are written again; the newest row of a reading holds. A reading leaves the
state when the watermark has passed its time by the horizon, and keeps its answer.

So within the horizon the result equals the batch join with the final history
(``dimensions.version_at``), in whatever order readings and versions come.

State per bucket: one version for each sensor and day on which one starts, and the
readings of the horizon, both as blocks of numbers. So a batch costs a few calls of the
state store for each bucket, whatever the number of its sensors, and all readings of a
bucket are looked up at once. New readings are appended; blocks are written anew when
an answer changes, and once a day without what the horizon has passed. The query needs
the RocksDB state store, which spills to disk.

Defined cases: rows without a sensor or a start are no versions; a reading without a
sensor or a time has no version; a reading that comes again replaces the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loopweave.streaming.feeds import event_time

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = "id long, station_id long, station_version long, change long"

#: Buckets of sensors; a checkpoint keeps the number it began with.
BUCKETS = 1024

_DAY_MS = 86_400_000
_NO_SENSOR = -1  # the bucket of readings without a sensor
_NO_DAY, _NO_TIME = -(1 << 31), -(1 << 63)
_VERSION = ["sensor", "day", "id"]
_READING = ["sensor", "named", "id", "day", "time", "version", "change"]
_BLOCK = 1 << 16  # rows in one block of readings


def _unpacked(blocks: list[bytes], columns: list[str]) -> dict[str, np.ndarray]:
    """Columns of all blocks, in their order."""
    parts = [np.frombuffer(b, "int64").reshape(len(columns), -1) for b in blocks]
    return dict(zip(columns, np.concatenate(parts, axis=1) if parts
                    else np.zeros((len(columns), 0), "int64")))


def _packed(table: dict[str, np.ndarray], columns: list[str]) -> bytes:
    return np.stack([table[c] for c in columns]).astype("int64").tobytes()


def _taken(table: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in table.items()}


def _latest(table: dict[str, np.ndarray], keys: list[str]) -> dict[str, np.ndarray]:
    """The last row of every key, sorted by the keys."""
    order = np.lexsort([table[k] for k in reversed(keys)])  # stable
    last = np.ones(len(order), bool)
    last[:-1] = np.any([table[k][order[1:]] != table[k][order[:-1]] for k in keys], axis=0)
    return _taken(table, order[last])


class VersionLookup(StatefulProcessor):
    """The versions and recent readings of a bucket of sensors."""

    def __init__(self, horizon_ms: int, default: int = -1):
        self.horizon, self.default = horizon_ms, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A version that comes again under its sensor and day replaces the one before.
        self.versions = handle.getValueState("versions", "rows binary")
        # By reading: its day, its event time, the last answer and how often it changed.
        self.readings = handle.getListState("readings", "rows binary")

    def _answers(self, versions: dict[str, np.ndarray], sensor: np.ndarray, day: np.ndarray
                 ) -> np.ndarray:
        """Ids of the last versions that start by the days; versions end where the next starts.

        ``versions`` are sorted by sensor and day.
        """
        if not len(versions["id"]):
            return np.full(len(sensor), self.default, "int64")
        sensors, place = np.unique(versions["sensor"], return_inverse=True)

        def ordered(number: np.ndarray, on: np.ndarray) -> np.ndarray:
            return number * (1 << 32) + (on - _NO_DAY)

        at = np.searchsorted(ordered(place, versions["day"]),
                             ordered(np.searchsorted(sensors, sensor), day), "right") - 1
        found = (at >= 0) & (versions["sensor"][at] == sensor)
        return np.where(found, versions["id"][at], self.default)

    def _kept(self, watermark: int) -> dict[str, np.ndarray]:
        """The readings of the horizon."""
        held = _latest(_unpacked([r[0] for r in self.readings.get()], _READING), _READING[:3])
        return _taken(held, held["time"] + self.horizon > watermark)

    def _store(self, readings: dict[str, np.ndarray]) -> None:
        n = len(readings["id"])
        if n:
            self.readings.put([(_packed(_taken(readings, slice(i, i + _BLOCK)), _READING),)
                               for i in range(0, n, _BLOCK)])
        else:
            self.readings.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        is_version = arrived["is_version"].to_numpy(bool)

        def arrivals(mine: np.ndarray, **columns: str) -> dict[str, np.ndarray]:
            return {c: arrived[name].to_numpy("int64")[mine] for c, name in columns.items()}

        watermark = timerValues.getCurrentWatermarkInMs()
        known = self.versions.get() if self.versions.exists() else None
        versions = _unpacked([known[0]] if known else [], _VERSION)
        changed = None
        if is_version.any():
            news = arrivals(is_version, sensor="sensor", day="day", id="id")
            versions = _latest({c: np.concatenate([versions[c], news[c]]) for c in _VERSION},
                               _VERSION[:2])
            self.versions.update((_packed(versions, _VERSION),))
            held = self._kept(watermark)
            found = self._answers(versions, held["sensor"], held["day"])
            other = found != held["version"]
            held["version"], held["change"] = found, held["change"] + other
            changed = _taken(held, other)
            if other.any():
                self._store(held)
        fresh = arrivals(~is_version, sensor="sensor", named="named", id="id", day="day",
                         time="time_ms")
        fresh["version"] = self._answers(versions, fresh["sensor"], fresh["day"])
        fresh["change"] = np.zeros(len(fresh["id"]), "int64")
        recent = _taken(fresh, fresh["time"] + self.horizon > watermark)
        for i in range(0, len(recent["id"]), _BLOCK):
            self.readings.appendValue((_packed(_taken(recent, slice(i, i + _BLOCK)), _READING),))
        if len(recent["id"]):
            # Whole days, so that the blocks of a bucket are cleared once a day.
            end = int(recent["time"].max()) + self.horizon
            self.handle.registerTimer(-(-end // _DAY_MS) * _DAY_MS)
        for told in (changed, fresh):
            if told is not None and len(told["id"]):
                yield pd.DataFrame({
                    "id": pd.arrays.IntegerArray(told["id"].copy(), told["named"] == 0),
                    "station_id": pd.arrays.IntegerArray(
                        told["sensor"].copy(), np.full(len(told["id"]), key[0] == _NO_SENSOR)),
                    "station_version": told["version"], "change": told["change"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._store(self._kept(timerValues.getCurrentWatermarkInMs()))
        yield pd.DataFrame([], columns=["id", "station_id", "station_version", "change"]).astype(
            "int64")

    def close(self) -> None:
        pass


def with_changing_history(readings: DataFrame, versions: DataFrame, horizon_days: int = 40,
                          late: str = "1 hour", key: str = "station_id", time: str = "time",
                          default: int = -1, buckets: int = BUCKETS) -> DataFrame:
    """(id, station_id, station_version, change): answers and, later, changed answers.

    ``readings`` is a stream of (id, ``key``, ``time``), ``versions`` one of (id,
    sensor_id, eff_start). ``change`` counts the answers of a reading from 0. ``buckets``
    is how many groups of sensors share the work; the checkpoint's next run needs the same.
    """
    spark = readings.sparkSession
    if spark.conf.get(STATE_STORE, "") != ROCKS_DB:
        raise ValueError(f"set {STATE_STORE} to {ROCKS_DB}")
    stamped = event_time(readings, time, late)
    # The column with the watermark goes, so that no row counts as too late; the watermark
    # itself still moves the state's clock.
    bucket = F.when(F.col("sensor").isNull(), _NO_SENSOR).otherwise(
        F.pmod(F.xxhash64("sensor"), F.lit(buckets)).cast("int"))
    # No nulls, so that numbers stay whole numbers on their way.
    asked = stamped.select(
        F.col(key).cast("long").alias("sensor"), F.col("id").isNotNull().cast("long").alias("named"),
        F.coalesce("id", F.lit(0)).cast("long").alias("id"),
        F.coalesce(F.unix_date(F.to_date(time)), F.lit(_NO_DAY)).alias("day"),
        F.coalesce(F.unix_millis("_event_time"), F.lit(_NO_TIME)).alias("time_ms"),
        F.lit(False).alias("is_version"))
    told = versions.filter(F.col("sensor_id").isNotNull() & F.col("eff_start").isNotNull()).select(
        F.col("sensor_id").cast("long").alias("sensor"), F.lit(1).cast("long").alias("named"),
        F.coalesce("id", F.lit(default)).cast("long").alias("id"),
        F.unix_date("eff_start").alias("day"), F.lit(0).cast("long").alias("time_ms"),
        F.lit(True).alias("is_version"))
    both = asked.unionByName(told).withColumn("bucket", bucket).withColumn(
        "sensor", F.coalesce("sensor", F.lit(0)))
    return both.groupBy("bucket").transformWithStateInPandas(
        VersionLookup(horizon_days * _DAY_MS, default), OUT, "Update", "EventTime")
