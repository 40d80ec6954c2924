"""Readers and writers on tiny files in the raw formats."""

import datetime as dt
import gzip
import io
import os
import tarfile

import pytest

from loopweave.plans import loads, profiles
from loopweave.schemas import fields
from loopweave.session import discard, scratch_path, shared_dir, staged
from loopweave.sources import published, readers, writers

LINE = ("01/13/2010 07:05:00,1100310,11,5,N,ML,.5,20,100,412,.0931,61.2,"
        "10,200,.09,62.0,1,10,212,.0962,60.4,1")


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def test_station_5min(spark, tmp_path):
    bad = LINE.replace("412", "abc")
    path = put(tmp_path / "a.txt.gz", f"{LINE}\n{bad}\n")
    good, wrong = readers.read_station_5min(spark, path).orderBy("bad_reading").collect()
    assert good["time"] == dt.datetime(2010, 1, 13, 7, 5)
    assert (good["station"], good["total_flow"], good["bad_reading"]) == (1100310, 412.0, False)
    assert (wrong["total_flow"], wrong["bad_reading"]) == (None, True)


def test_feed_parts_share_the_observation_id(spark, tmp_path):
    parts = readers.split_station_feed(spark, put(tmp_path / "a.txt.gz", LINE + "\n"))
    ids = {name: {r["observation_id"] for r in df.collect()} for name, df in parts.items()}
    assert ids["station"] == ids["lane"] == ids["observation"]
    lanes = parts["lane"].orderBy("lane").collect()
    assert [(r["lane"], r["flow"], r["observed"]) for r in lanes] == [(0, 200, 1), (1, 212, 1)]


def test_blank_fields_are_zero_in_the_feed(spark, tmp_path):
    path = put(tmp_path / "a.txt", LINE.replace(",412,", ",,") + "\n")
    assert readers.split_station_feed(spark, path)["observation"].first()["total_flow"] == 0.0
    assert readers.read_station_5min(spark, path).first()["bad_reading"] is True


def test_profile_of_a_broken_day(spark, tmp_path):
    lines = [LINE.replace("07:05", f"{h:02d}:{m:02d}") for h in range(24) for m in range(0, 60, 5)]
    whole = put(tmp_path / "whole.txt", "\n".join(lines + lines[:3]) + "\n")
    day = profiles.station_days(readers.read_station_5min(spark, whole)).first()
    assert (day["day_of_year"], day["day_of_week"], day["direction"]) == (13, 4, 1)
    assert len(day["total_flow"]) == 288 and set(day["total_flow"]) == {412.0}
    broken = put(tmp_path / "broken.txt", "\n".join(
        [lines[0].replace("412", "abc")] + lines[1:]) + "\n")
    feed = readers.read_station_5min(spark, broken)
    assert profiles.station_days(feed).count() == 0
    assert profiles.station_days(feed, strict=False).first()["total_flow"][0] == 0.0


def test_station_meta_and_dimension(spark, tables, tmp_path):
    head = ("ID\tFwy\tDir\tDistrict\tCounty\tCity\tState_PM\tAbs_PM\tLatitude\tLongitude\tLength\t"
            "Type\tLanes\tName\tUser_ID_1\tUser_ID_2\tUser_ID_3\tUser_ID_4\n")
    row = "7\t5\tN\t11\t73\t{city}\tR12.5\t1.5\t{lat}\t-117.1\t.5\tML\t4\tMAIN ST\t\t\t\t\n"
    for date, lat in (("2010_01_13", "32.7"), ("2010_03_01", "32.8"), ("2010_05_01", "")):
        put(tmp_path / f"d11_text_meta_{date}.txt", head + row.format(city="", lat=lat))
    meta = readers.read_station_meta(spark, str(tmp_path))
    made = loads.station_dimension(meta, tables.st_type)
    got = [(r["id"], r["eff_start"], r["eff_end"], r["state_pm"]) for r in
           made["traffic_station"].orderBy("id").collect()]
    # A row with one coordinate is kept, as in the loads this follows.
    assert got == [(1, dt.date(2010, 1, 13), dt.date(2010, 3, 1), 12.5),
                   (2, dt.date(2010, 3, 1), dt.date(2010, 5, 1), 12.5),
                   (3, dt.date(2010, 5, 1), None, 12.5)]
    assert made["county_city"].first()["city"] == -1


def test_precipitation_files_in_a_tree(spark, tmp_path):
    good = "HPD04001207HPCPHI2010010031003 0100 00012  0200 00000I 2500 00012 "
    put(tmp_path / "2010" / "ca" / "one.txt", f"{good}\nshort\n")
    put(tmp_path / "2011" / "two.txt", f"{good}\n")
    records, refused = readers.read_hourly_precipitation(spark, str(tmp_path))
    assert records.count() == 2
    assert [r["value"] for r in refused.collect()] == ["short"]
    row = records.first()
    assert (row["station_number"], row["day"], row["value_count"]) == ("0012", "0031", "003")
    stations = spark.createDataFrame([(12, "A")], "id int, name string")
    made = loads.precipitation_facts(records, stations)
    assert made["hourly"].count() == 4 and made["daily"].count() == 2


def test_hour_24_rolls_to_the_next_day(spark, tmp_path):
    put(tmp_path / "one.txt", "HPD04001207HPCPHI2010010031001 2400 00012\n")
    records, _ = readers.read_hourly_precipitation(spark, str(tmp_path))
    stations = spark.createDataFrame([(12, "A")], "id int, name string")
    assert loads.precipitation_facts(records, stations)["hourly"].first()["time"] == dt.datetime(
        2010, 2, 1)


def pivot_line(n):
    return "[" + ",".join(["7", "11", "2010", "13", "4", "1"] + ["1.5"] * n) + "]\n"


def test_pivot_text_fails_on_a_bad_line(spark, tmp_path):
    good = readers.read_pivot_text(spark, put(tmp_path / "a.txt", pivot_line(8)), ["f", "s"], 4)
    assert good.first()["s"] == [1.5] * 4
    short = readers.read_pivot_text(spark, put(tmp_path / "b.txt", pivot_line(7)), ["f", "s"], 4)
    with pytest.raises(Exception, match="expected 14 fields"):
        short.collect()


def test_numeric_csv_drops_bad_lines(spark, tmp_path):
    path = put(tmp_path / "a.csv", "LEN,X\n1,2\nfoo,3\n4,\n5,6\n")
    assert sorted(map(tuple, readers.read_numeric_csv(spark, path).collect())) == [(1.0, 2.0),
                                                                                 (5.0, 6.0)]


def test_controlled_read_names_file_field_and_text(spark, tmp_path):
    path = put(tmp_path / "a.csv", '1,"a,b",2\nx,c,y\n3\n')
    good, errors = readers.read_controlled(spark, path, fields("k int, s string, v double"))
    assert [tuple(r) for r in good.collect()] == [(1, "a,b", 2.0)]
    got = {(r["field"], r["text"]) for r in errors.collect()}
    assert got == {("k", "x"), ("v", "y"), (None, "3")}
    assert errors.first()["file"].endswith("a.csv")


def test_tar_gz_members(spark, tmp_path):
    archive = tmp_path / "x.tar.gz"
    with tarfile.open(archive, "w:gz") as tar:
        for name, body in (("a.csv", "1\n2\n"), ("d/b.csv", "3")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    got = sorted(map(tuple, readers.read_tar_gz(spark, str(archive)).collect()))
    assert got == [("a.csv", "1"), ("a.csv", "2"), ("d/b.csv", "3")]


def test_json_array_file(spark, tmp_path):
    path = put(tmp_path / "a.json", '[{"station": 1, "zip": 92101},\n {"station": 2}]')
    got = readers.read_json_records(spark, path, "station long, zip long").collect()
    assert sorted((r["station"], r["zip"]) for r in got) == [(1, 92101), (2, None)]


def test_row_batches(spark):
    batches, total = [], []
    for batch in readers.row_batches(spark.range(1200), lambda r: r["id"], 500, total.append):
        batches.append(len(batch))
    assert batches == [500, 500, 200] and total == [1200]


def test_home_values_keep_recent_months(spark, tmp_path):
    path = put(tmp_path / "z.csv", "RegionName,City,State,Metro,CountyName,2007-12,2008-01,2009-02\n"
               "92101,O'Side,CA,SD,SD,1,2,\n")
    made = loads.home_values(readers.read_home_values(spark, path))
    got = sorted((r["zip"], str(r["month"]), r["avg_value"]) for r in
                 made["home_value"].collect())
    assert got == [(92101, "2008-01-01", 2.0), (92101, "2009-02-01", None)]
    assert made["county_zip"].first()["city"] == "OSide"


def test_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_table(spark.range(5), path)
    writers.replace_table(spark.range(2), path)
    assert published.read(spark, path, "table").count() == 2


def test_staged_tables_lie_in_the_shared_folder_and_go(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    df, empty = staged(spark.range(10)), staged(spark.range(0))
    assert (df.count(), empty.count()) == (10, 0)
    assert os.path.isdir(df.staged_at) and df.staged_at.startswith(shared_dir(spark))
    discard(df, empty)
    assert not os.path.exists(df.staged_at)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Unset:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Unset()

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
