"""Edge cases of the operators: nulls, empty ranges, repeated keys, borders."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.functions import geo, scalars, sql
from loopweave.operators import (aggregates, clustering, dimensions, reshape, sampling, spatial)
from loopweave.sources import readers, writers
from loopweave.streaming import feeds


def test_no_distance_without_coordinates(spark, rows):
    df = rows("a double, b double, c double, d double", [(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0),
                                                         (0.0, 0.0, 0.0, None), (0.0, 5.0, 0.0, 5.0)])
    away = geo.distance_m(*(F.col(c) for c in "abcd"))
    want = [pytest.approx(111195.08, abs=0.1), None, None, 0.0]
    assert [r[0] for r in df.select(away).collect()] == want
    sql.register_functions(spark)
    assert [r[0] for r in df.selectExpr("distance_m(a, b, c, d)").collect()] == want


def test_unmatched_rows_have_no_distance(rows):
    left = rows("id int, latitude double, longitude double", [(1, 10.0, 10.0), (2, None, 1.0)])
    right = rows("id int, latitude double, longitude double", [(9, 50.0, 10.0)])
    got = spatial.near_join(left, right, 1000).collect()
    assert {(r.id, r.id_r, r.metres) for r in got} == {(1, None, None), (2, None, None)}


def test_near_join_crosses_the_date_line_and_the_pole(rows):
    left = rows("id int, latitude double, longitude double", [
        (1, 0.0, 179.9999), (2, 89.9999, 10.0), (3, 0.0, -179.9999), (4, 0.0, 0.0)])
    right = rows("id int, latitude double, longitude double", [
        (11, 0.0, -179.9999), (12, 89.9999, -170.0), (13, 0.0, 179.9998), (14, 0.0, 0.0001)])
    got = {(r.id, r.id_r) for r in spatial.near_join(left, right, 50, how="inner").collect()}
    assert got == {(1, 11), (1, 13), (2, 12), (3, 11), (3, 13), (4, 14)}


def test_areas_of_very_different_size(rows):
    points = rows("longitude double, latitude double", [(0.5, 0.5), (150.0, 40.0), (500.0, 0.0),
                                                        (None, 1.0)])
    areas = spatial.rectangle_rings(rows(
        "k string, x0 double, y0 double, x1 double, y1 double",
        [("small", 0.0, 0.0, 1.0, 1.0), ("world", -180.0, -90.0, 180.0, 90.0)]), "k")
    got = {(r.longitude, r.a) for r in spatial.containing_area(points, areas, "k", "a").collect()}
    assert got == {(0.5, "small"), (150.0, "world"), (500.0, None), (None, None)}


def test_readings_outside_the_slots_fill_no_gap(rows):
    df = rows("k int, slot int, v double", [(1, s, 1.0) for s in (0, 1, 2, 4)]
              + [(2, s, 1.0) for s in (-1, 0, 1, 2, 3, 9)])
    got = reshape.slot_profiles(df, ["k"], "slot", ["v"], slots=4).collect()
    assert [(r.k, r.v) for r in got] == [(2, [1.0] * 4)]


def test_fractions_of_none_and_all(spark):
    df = spark.range(1000)
    assert [sampling.hash_fraction(df, ["id"], f).count() for f in (0.0, 1.0)] == [0, 1000]
    assert [d.count() for d in sampling.hash_split(df, ["id"], 1.0)] == [1000, 0]
    for wrong in (-0.1, 1.1):
        with pytest.raises(ValueError):
            sampling.hash_fraction(df, ["id"], wrong)


def test_histogram_of_a_constant_column(rows):
    df = rows("x double, y double", [(5.0, 0.0), (5.0, 1.0), (5.0, 1.0), (5.0, None)])
    got = {tuple(r) for r in aggregates.histogram_2d(df, "x", "y", 4).collect()}
    assert got == {(0, 0, 1), (0, 3, 2), (0, None, 1)}


def test_repeated_changes_update_once(rows):
    df = rows("k int, v string", [(1, "a"), (2, "b")])
    changes = rows("key int, new string", [(1, "y"), (1, "x"), (3, "z")])
    got = dimensions.update_by_key(df, changes, {"k": "key"}, {"new": "v"}, {"v": "old"})
    assert {tuple(r) for r in got.collect()} == {(1, "x"), (2, "old")}


def test_match_flag_counts_null_keys_as_missing(rows):
    df, parent = rows("k int", [(1,), (1,), (2,), (None,)]), rows("p int", [(1,), (1,), (None,)])
    got = sorted((r.k, r.known) for r in dimensions.with_match(
        df, parent, {"k": "p"}, "known").fillna(-1, subset=["k"]).collect())
    assert got == [(-1, False), (1, True), (1, True), (2, False)]


def test_kmeans_without_outliers_and_round_limits(rows):
    data = [(i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(20)]
    df = rows("id int, v array<double>", data)
    centres = np.array([[0.0, 0.0], [1.0, 0.0]])
    assert clustering.kmeans_outliers(df, ["id"], "v", 2, 0, centres=centres).count() == 0
    assert clustering.kmeans_outliers(df, ["id"], "v", 2, 30, centres=centres).count() == 20
    with pytest.raises(RuntimeError, match="not converged"):
        clustering.lloyd(df, "v", centres, most=1)
    assert np.allclose(clustering.lloyd(df, "v", centres), [[0.09, 0], [10.1, 0]])


def test_surplus_and_short_lines_are_errors(spark, tmp_path):
    (tmp_path / "f.csv").write_text('1,a,3,4.0\n2,b,3,4.0,EXTRA,MORE\n3,"x,y",5\n4,"p,q",5,6.0\n'
                                    '5,b,3,4.0,\n6,,,\n')
    schema = readers.T.StructType.fromDDL("id int, name string, n int, price double")
    good, bad = readers.read_controlled(spark, str(tmp_path / "f.csv"), schema)
    assert {tuple(r) for r in good.collect()} == {(1, "a", 3, 4.0), (4, "p,q", 5, 6.0),
                                                  (6, None, None, None)}
    assert {(r.record[0], r.field) for r in bad.collect()} == {("2", None), ("3", None), ("5", None)}


@pytest.mark.parametrize("path,day", [
    ("/feeds/2011_01_01/d11_text_meta_2012_03_04.txt", dt.date(2012, 3, 4)),
    ("d11_text_meta_2012_03_04.txt.gz", dt.date(2012, 3, 4)),
    ("/feeds/2011_01_01/none.txt", None), ("/x/2010_01_02_2011_03_04.txt", dt.date(2011, 3, 4))])
def test_the_date_is_the_file_names(rows, path, day):
    assert rows("p string", [(path,)]).select(scalars.date_in_path(F.col("p"))).first()[0] == day


def test_matrix_rows_keep_their_place(spark, tmp_path):
    for i, n in enumerate((1, 900, 20)):
        (tmp_path / f"part-{i}.csv").write_text("".join(f'"{i}","{j}"\n' for j in range(n)))
    got = sorted((r.row, tuple(r["values"])) for r in readers.read_matrix_csv(
        spark, str(tmp_path), 2).collect())
    want = [(float(i), float(j)) for i, n in enumerate((1, 900, 20)) for j in range(n)]
    assert got == [(k, v) for k, v in enumerate(want)]


def test_archives_in_a_store_that_only_spark_opens(spark, tmp_path):
    import tarfile
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.txt", "a.txt")
    spark._jsc.hadoopConfiguration().set(
        "fs.viewfs.mounttable.archives.link./in", f"file://{tmp_path}")
    for path in (str(tmp_path / "x.tar.gz"), "viewfs://archives/in/x.tar.gz"):
        assert [tuple(r) for r in readers.read_tar_gz(spark, path).collect()] == [
            ("a.txt", "one"), ("a.txt", "two")]


def test_streams_refuse_zones_whose_clocks_change(spark):
    stream = spark.readStream.format("rate").load().withColumnRenamed("timestamp", "time")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        with pytest.raises(ValueError, match="UTC"):
            feeds.without_duplicates(stream, ["value"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_vectors_are_read_back_in_their_order(spark, tmp_path):
    df = spark.range(500).select("id", F.array(F.col("id") * 1.0, F.lit(0.5)).alias("v"))
    path = writers.write_vectors(df.repartition(7), "v", 2, str(tmp_path / "m"), order=["id"])
    got = sorted((r.row, r["values"][0]) for r in readers.read_matrix_csv(spark, path, 2).collect())
    assert got == [(i, float(i)) for i in range(500)]
