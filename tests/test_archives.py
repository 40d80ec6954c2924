"""Indexed archives: several tasks for one file, plain tools, pruned columns, rare contents."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from loopweave.session import scratch_path
from loopweave.sources import archives


@pytest.fixture
def packed(spark):
    """One archive of 3,000 lines in many entries: (folder, index)."""
    folder = scratch_path(spark, "archives")
    lines = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("line "), "id").alias("value"))
    return folder, archives.write_archives(lines, folder, entry_bytes=2000)


def test_one_archive_is_many_tasks(spark, packed):
    _, index = packed
    assert spark.read.parquet(index).select("file").distinct().count() == 1
    read = archives.read_archives(spark, index, run_bytes=1500)
    assert read.rdd.getNumPartitions() > 3
    assert sorted(r.line for r in read.collect()) == sorted(f"line {i}" for i in range(3000))
    assert archives.read_archives(spark, index).rdd.getNumPartitions() == 1


def test_index_and_archive_agree(spark, packed):
    _, index = packed
    counts = {r.entry: r.lines for r in spark.read.parquet(index).collect()}
    got = archives.read_archives(spark, index, run_bytes=4000).groupBy("member").count().collect()
    assert {r["member"]: r["count"] for r in got} == counts and sum(counts.values()) == 3000


def test_other_tools_read_the_archive(spark, packed):
    _, index = packed
    path = spark.read.parquet(index).first().file
    with tarfile.open(path, "r:gz") as archive:
        names = archive.getnames()
        first = archive.extractfile(names[0]).read().decode().splitlines()
    assert first[0] == "line 0" and len(names) == spark.read.parquet(index).count()
    plain = archives.read_archives(spark, files=[path])
    assert plain.count() == 3000 and plain.rdd.getNumPartitions() == 1


def test_only_the_columns_asked_for(spark, packed):
    _, index = packed
    lines = archives.read_archives(spark, index, schema="line string")
    assert lines.columns == ["line"] and lines.count() == 3000
    turned = archives.read_archives(spark, index, schema="line string, member string")
    assert turned.first().line.startswith("line") and turned.first().member.endswith(".txt")
    with pytest.raises(Exception, match="not size"):
        archives.read_archives(spark, index, schema="size string").collect()


def test_rare_lines_and_empty_input(spark):
    texts = ["", None, "é漢 x", "tab\there", "x" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    index = archives.write_archives(rows, scratch_path(spark, "archives"), entry_bytes=10)
    got = [r.line for r in archives.read_archives(spark, index, run_bytes=1).collect()]
    assert sorted(got) == sorted(t or "" for t in texts)
    none = archives.write_archives(rows.filter("value = 'no'"), scratch_path(spark, "archives"))
    assert archives.read_archives(spark, none).collect() == []
    assert archives.read_archives(spark, files=[]).collect() == []


def test_foreign_archives(spark, tmp_path):
    path = tmp_path / "foreign.tar.gz"
    with tarfile.open(path, "w:gz") as archive:
        for name, body in (("a.txt", b"1\r\n2\n"), ("empty.txt", b""), ("b/c.txt", b"3")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        archive.addfile(folder)
    got = [(r.member, r.line) for r in archives.read_archives(spark, files=[str(path)]).collect()]
    assert got == [("a.txt", "1"), ("a.txt", "2"), ("b/c.txt", "3")]
