"""Loads that add to what is stored: published versions, histories, file ledgers, enrichment."""

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loopweave.operators import dimensions, history
from loopweave.plans import loads
from loopweave.session import scratch_path
from loopweave.sources import published, readers, writers
from loopweave.streaming import enrichment, feeds, ledger

DAY = dt.date


@pytest.fixture
def root(spark):
    return scratch_path(spark, "publication")


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# --- published versions


def test_nothing_is_published_at_first(spark, root):
    assert published.version(spark, root) is None and published.numbers(spark, root) == []
    with pytest.raises(FileNotFoundError):
        published.read(spark, root, "t")


def test_a_load_replaces_all_tables_or_none(spark, root):
    published.load(spark, root, {"a": spark.range(3), "b": spark.range(4)})
    bad = spark.range(5).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("x"))
                                                 .cast("long")).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        published.load(spark, root, {"a": spark.range(9), "b": bad})
    with pytest.raises(published.AuditFailed, match="b: nulls in id"):
        published.load(spark, root, {"a": spark.range(9), "b": spark.range(2).select(
            F.lit(None).cast("long").alias("id"))}, {"b": [published.complete("id")]})
    assert [published.read(spark, root, n).count() for n in "ab"] == [3, 4]
    published.load(spark, root, {"b": spark.range(6)})
    assert [published.read(spark, root, n).count() for n in "ab"] == [3, 6]
    assert published.numbers(spark, root) == [1, 2]


def test_a_failed_load_leaves_no_data(spark, root):
    published.load(spark, root, {"a": spark.range(3)})
    before = os.listdir(f"{root}/data")
    with pytest.raises(published.AuditFailed):
        writers.replace_table(spark.range(0), root, "a", [published.not_empty])
    assert os.listdir(f"{root}/data") == before


def test_the_second_of_two_loads_is_refused(spark, root):
    first = published.load(spark, root, {"a": spark.range(3)})
    stored = published.written(spark.range(4), root)
    published.publish(spark, root, {"a": stored}, first)
    with pytest.raises(published.Conflict):
        published.publish(spark, root, {"a": published.written(spark.range(5), root)}, first)
    assert published.read(spark, root, "a").count() == 4
    assert not [n for n in os.listdir(f"{root}/versions") if "json" not in n]


def test_a_reader_keeps_its_version(spark, root):
    published.load(spark, root, {"a": spark.range(3)})
    reader = published.read(spark, root, "a")
    published.load(spark, root, {"a": spark.range(7)})
    assert reader.count() == 3 and published.read(spark, root, "a").count() == 7
    assert published.read(spark, root, "a", published.version(spark, root, 1)).count() == 3


def test_a_load_may_read_what_it_replaces(spark, root):
    published.load(spark, root, {"a": spark.range(3)})
    for _ in range(2):
        writers.replace_table(published.read(spark, root, "a").withColumn(
            "id", F.col("id") * 10), root, "a")
    assert values(published.read(spark, root, "a")) == [(0,), (100,), (200,)]


def test_forgotten_versions_go_with_the_folders_only_they_use(spark, root):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, p string")
    first = published.publish(spark, root, {"t": published.written(rows, root, "p")}, None)
    new = published.written(rows.filter("p = 'y'").withColumn("id", F.col("id") + 10), root, "p")
    old = first.tables["t"]
    table = published.Stored(old.schema, old.parts | new.parts)
    second = published.publish(spark, root, {"t": table}, first)
    assert second.tables["t"].parts["x"] == old.parts["x"]
    assert published.forget(spark, root, keep=1) == 1  # the old folder of y alone
    got = published.read(spark, root, "t", part="p")
    assert values(got, "id", "p") == [(1, "x"), (12, "y"), (13, "y")]
    assert published.forget(spark, root, keep=1) == 0


# --- histories

VERSION = "sensor_id long, eff_start date, name string, lanes int"


def test_two_snapshots_equal_one(spark, root, rows):
    a = [(1, DAY(2010, 1, 1), "one", 2), (2, DAY(2010, 5, 1), "two", 3), (1, DAY(2011, 1, 1), "x", 1)]
    b = [(1, DAY(2010, 6, 1), "between", 4), (3, DAY(2009, 1, 1), "three", 1),
         (1, DAY(2010, 1, 1), "aaa ahead", 9), (2, DAY(2010, 5, 1), "zzz behind", 9)]
    first = history.merge_history(spark, root, rows(VERSION, a), tie_break=["name"], parts=4)
    old = {r[1:3]: r[0] for r in values(published.read(spark, root, "traffic_station"),
                                        "id", "sensor_id", "eff_start")}
    history.merge_history(spark, root, rows(VERSION, b), tie_break=["name"])
    got = published.read(spark, root, "traffic_station")
    want = dimensions.station_history(rows(VERSION, a + b), "sensor_id", "eff_start",
                                      tie_break=["name"])
    names = ("sensor_id", "eff_start", "eff_end", "name", "lanes")
    assert values(got, *names) == values(want, *names)
    ids = {r[1:3]: r[0] for r in values(got, "id", "sensor_id", "eff_start")}
    assert all(ids[k] == i for k, i in old.items()) and sorted(ids.values()) == [1, 2, 3, 4, 5]
    assert (ids[1, DAY(2010, 6, 1)], ids[3, DAY(2009, 1, 1)]) == (4, 5)
    assert values(history.moved(published.read(spark, root, "traffic_station", first), got)) == [
        (ids[1, DAY(2010, 1, 1)], DAY(2011, 1, 1), DAY(2010, 6, 1))]


def test_untouched_parts_keep_their_folders(spark, root, rows):
    a = [(i, DAY(2010, 1, 1), f"s{i}", 1) for i in range(40)]
    first = history.merge_history(spark, root, rows(VERSION, a), parts=8)
    # The whole feed again, with one more version of one sensor.
    again = a + [(7, DAY(2012, 1, 1), "s7", 2)]
    second = history.merge_history(spark, root, rows(VERSION, again))
    one, two = (v.tables["traffic_station"].parts for v in (first, second))
    assert len(one) == 8 and sum(one[p] != two[p] for p in one) == 1
    for snapshot in (again, a, []):  # nothing new: nothing is published
        assert history.merge_history(spark, root, rows(VERSION, snapshot)).number == second.number


def test_versions_without_sensor_or_start_are_left_out(spark, root, rows):
    made = history.merge_history(spark, root, rows(VERSION, [
        (None, DAY(2010, 1, 1), "a", 1), (1, None, "b", 1)]))
    assert published.read(spark, root, "traffic_station").count() == 0
    assert made.tables["traffic_station"].notes["last_id"] == 0
    history.merge_history(spark, root, rows(VERSION, [(1, DAY(2010, 1, 1), None, None)]))
    assert values(published.read(spark, root, "traffic_station"), "id", "name") == [(1, None)]


def test_facts_that_a_load_takes_from_their_version(spark, root, rows):
    history.merge_history(spark, root, rows(VERSION, [(1, DAY(2010, 1, 1), "a", 1)]))
    before = published.read(spark, root, "traffic_station")
    facts = dimensions.version_at(rows("id long, sensor long, day date", [
        (1, 1, DAY(2010, 2, 1)), (2, 1, DAY(2010, 3, 1)), (3, 1, DAY(2009, 1, 1))]),
        before, "sensor", "day", "sensor_id")
    history.merge_history(spark, root, rows(VERSION, [(1, DAY(2010, 2, 15), "b", 1)]))
    ends = history.moved(before, published.read(spark, root, "traffic_station"))
    assert values(history.facts_to_move(facts, ends, "day"), "id") == [(2,)]


def test_dimension_keys_with_nulls_come_once(spark, root, rows):
    first = history.merged_dimension(spark, root, None, rows(
        "num int, direction string, d int", [(5, "N", 1), (5, None, 2), (None, None, 3)]),
        ["num", "direction"], ["d"])
    second = history.merged_dimension(spark, root, first, rows(
        "num int, direction string, d int", [(5, None, 9), (5, "N", 9), (4, "S", 9), (4, "S", 8)]),
        ["num", "direction"], ["d"])
    assert values(published.table(spark, second), "id", "num", "direction", "d") == [
        (1, 5, None, 2), (2, 5, "N", 1), (3, 4, "S", 8)]
    assert history.merged_dimension(spark, root, second, published.table(spark, second),
                                    ["num", "direction"], ["d"]) is second


def test_station_loads_keep_all_ids(spark, root, tables):
    from loopweave.catalog.reading import raw_station_meta

    meta = readers.read_station_meta(spark, raw_station_meta(tables))
    early = F.col("eff_start") < "1996-01-01"
    first = loads.station_load(meta.filter(early), tables.st_type, root)
    before = {n: values(first[n]) for n in ("freeways", "county_city")}
    ids = values(first["traffic_station"], "id", "sensor_id", "eff_start")
    second = loads.station_load(meta, tables.st_type, root)
    for name, kept in before.items():
        assert set(kept) <= set(values(second[name]))
    assert set(ids) <= set(values(second["traffic_station"], "id", "sensor_id", "eff_start"))
    whole = loads.station_dimension(meta, tables.st_type)["traffic_station"]
    names = ("sensor_id", "eff_start", "eff_end", "name", "lanes", "location")
    assert values(second["traffic_station"], *names) == values(whole, *names)
    number = published.version(spark, root).number
    assert second["moved"].count() > 0
    third = loads.station_load(meta, tables.st_type, root)
    assert published.version(spark, root).number == number and third["moved"].count() == 0


# --- file ledgers


def read_numbers(spark, names):
    return (spark.read.schema("n long").csv(names) if names
            else spark.createDataFrame([], "n long"))


def put(folder, name, numbers, stamp=None):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("".join(f"{n}\n" for n in numbers))
    if stamp:
        os.utime(path, (stamp, stamp))
    return path


def test_files_that_come_change_and_go(spark, root, tmp_path):
    feed = tmp_path / "feed"

    def run():
        counts = ledger.follow(spark, str(feed), root, read_numbers)
        return counts, [n for (n,) in values(ledger.rows(spark, root))]

    assert run() == ({}, [])  # no folder yet
    put(feed, "a.csv", [1, 2], 1000)
    put(feed, "b.csv", [3], 1000)
    put(feed, "empty.csv", [], 1000)
    assert run() == ({"new": 2}, [1, 2, 3])
    version = published.version(spark, root).number
    assert run() == ({"same": 2}, [1, 2, 3])
    assert published.version(spark, root).number == version
    folders = published.version(spark, root).tables["rows"].parts
    put(feed, "c.csv", [4], 1000)
    assert run() == ({"same": 2, "new": 1}, [1, 2, 3, 4])
    grown = published.version(spark, root).tables["rows"].parts
    assert all(grown[p] == f for p, f in folders.items())  # new files rewrite nothing
    put(feed, "a.csv", [7, 8, 9], 1000)  # longer, same time
    put(feed, "b.csv", [5], 2000)  # same length, later
    put(feed, "c.csv", [4], 3000)  # only its time
    assert run() == ({"changed": 2, "touched": 1}, [4, 5, 7, 8, 9])
    assert run()[0] == {"same": 3}
    (feed / "a.csv").unlink()
    put(feed, "_skipped.csv", [100])
    assert run() == ({"same": 2, "gone": 1}, [4, 5])
    put(feed, "b.csv", [])  # no bytes: as if it went
    (feed / "c.csv").unlink()
    assert run() == ({"gone": 2}, [])


def test_a_failed_run_can_be_repeated(spark, root, tmp_path):
    feed = tmp_path / "feed"
    put(feed, "a.csv", [1], 1000)
    ledger.follow(spark, str(feed), root, read_numbers)
    put(feed, "a.csv", [2, 3], 2000)

    def broken(spark, names):
        return read_numbers(spark, names).withColumn("n", F.raise_error(F.lit("x")).cast("long"))

    with pytest.raises(PySparkException):
        ledger.follow(spark, str(feed), root, broken)
    assert values(ledger.rows(spark, root)) == [(1,)]
    assert ledger.follow(spark, str(feed), root, read_numbers) == {"changed": 1}
    assert values(ledger.rows(spark, root)) == [(2,), (3,)]


# --- enrichment by a changing history


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(enrichment.STATE_STORE)
    spark.conf.set(enrichment.STATE_STORE, enrichment.ROCKS_DB)
    yield
    spark.conf.set(enrichment.STATE_STORE, before)


def test_answers_follow_late_versions_within_the_horizon(spark, rows, rocks):
    asked, told, out, mark = (scratch_path(spark, n) for n in ("asked", "told", "out", "mark"))
    reading, version = "id long, station_id long, time timestamp_ntz", \
        "id long, sensor_id long, eff_start date"

    def turn(readings, versions):
        rows(reading, readings).write.mode("append").parquet(asked)
        rows(version, versions).write.mode("append").parquet(told)
        stream = enrichment.with_changing_history(
            feeds.arriving_files(spark, asked, reading), feeds.arriving_files(spark, told, version),
            horizon_days=5)
        feeds.drain_updates(stream, out, mark)
        return values(feeds.latest_updates(spark, out, ["id"]), "id", "station_version", "change")

    noon = lambda d: dt.datetime(2020, 1, d, 12)
    assert turn([(1, 7, noon(2)), (2, 8, noon(2))], []) == [(1, -1, 0), (2, -1, 0)]
    # A version that arrives in the second batch reaches the reading of the first and of the third.
    assert turn([], [(70, 7, DAY(2020, 1, 1))]) == [(1, 70, 1), (2, -1, 0)]
    assert turn([(3, 7, noon(3))], []) == [(1, 70, 1), (2, -1, 0), (3, 70, 0)]
    # Its successor takes over from its first day on.
    assert turn([], [(71, 7, DAY(2020, 1, 3))]) == [(1, 70, 1), (2, -1, 0), (3, 71, 1)]
    # The watermark moves past the horizon; then answers stay, and new readings still find all.
    turn([(4, 9, noon(20))], [])
    turn([(5, 9, noon(21))], [])
    assert turn([(6, 7, noon(21))], [(72, 7, DAY(2020, 1, 1)), (80, 8, DAY(2019, 1, 1))]) == [
        (1, 70, 1), (2, -1, 0), (3, 71, 1), (4, -1, 0), (5, -1, 0), (6, 71, 0)]


def test_many_sensors_share_few_states(spark, rows, rocks):
    """Sensors of one bucket keep their own versions; the work goes by buckets, not by sensors."""
    reading, version = "id long, station_id long, time timestamp_ntz", \
        "id long, sensor_id long, eff_start date"
    big = (1 << 60) + 1
    noon = lambda d: dt.datetime(2020, 1, d, 12)
    asked, told, out, mark = (scratch_path(spark, n) for n in ("asked", "told", "out", "mark"))
    keys = [*range(-40, 40), big]

    def turn(readings, versions):
        rows(reading, readings).write.mode("append").parquet(asked)
        rows(version, versions).write.mode("append").parquet(told)
        stream = enrichment.with_changing_history(
            feeds.arriving_files(spark, asked, reading), feeds.arriving_files(spark, told, version),
            buckets=3)
        feeds.drain_updates(stream, out, mark)

    turn([(i, k, noon(1 + i % 9)) for i, k in enumerate(keys)] + [(900, None, noon(2)),
                                                                  (big, 5, noon(2))],
         [(i * 10 + 1, k, DAY(2020, 1, 4)) for i, k in enumerate(keys) if i % 2])
    turn([(100 + i, k, noon(9)) for i, k in enumerate(keys)], [(7, None, DAY(2019, 1, 1))])
    turn([], [(i * 10, k, DAY(2019, 1, 1)) for i, k in enumerate(keys) if i % 3]
         + [(i * 10 + 2, k, DAY(2020, 1, 6)) for i, k in enumerate(keys) if i % 5 == 0])

    def valid(i, day):
        held = [(1, i * 10)] * bool(i % 3) + [(4, i * 10 + 1)] * (i % 2) + [(6, i * 10 + 2)] * (i % 5 == 0)
        return max([(d, v) for d, v in held if d <= day], default=(0, -1))[1]

    got = {r.id: (r.station_id, r.station_version) for r in feeds.latest_updates(
        spark, out, ["id"]).collect()}
    want = {i: (k, valid(i, 1 + i % 9)) for i, k in enumerate(keys)}
    want |= {100 + i: (k, valid(i, 9)) for i, k in enumerate(keys)}
    assert got == want | {900: (None, -1), big: (5, valid(45, 2))}
    state = spark.read.format("statestore").option("stateVarName", "versions").load(mark)
    assert 1 <= state.count() <= 3


def test_the_state_store_has_to_be_named(spark, rows):
    with pytest.raises(ValueError, match="RocksDB"):
        folder = scratch_path(spark, "none")
        rows("id long, station_id long, time timestamp_ntz", []).write.parquet(folder)
        stream = feeds.arriving_files(spark, folder, "id long, station_id long, time timestamp_ntz")
        enrichment.with_changing_history(stream, stream)
