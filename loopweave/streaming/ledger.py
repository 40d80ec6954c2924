"""Feed folders whose files change: a ledger of what was read, and rows that follow it.

``follow`` compares the files of a folder with the ledger of the last run. New files
are read; a file that was rewritten under its old name replaces the rows it gave
before; the rows of a file that went go as well. Ledger and rows are two tables of
one publication, so they change together or not at all, and a run that fails can be
repeated.

The ledger knows the name, length, modification time and SHA-256 of every file. Only
files whose length or time differ are read for their digest; those whose content is
the same keep their rows. The rows of a run are a part of the published table, so
new files never rewrite old rows, and a changed one rewrites only the parts that
hold rows of it.

Defined cases: an empty folder and a folder that does not exist hold no files; a file of
no bytes counts as none; a run without changes publishes nothing; names that start with a
dot or an underscore are no feed files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.session import discard, staged
from loopweave.sources import published
from loopweave.sources.published import Stored

LEDGER = "name string, length long, modified timestamp, digest string, part string"

Read = Callable[[SparkSession, list[str]], DataFrame]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, modified) of the files below a folder; no content is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string, length long, modified timestamp")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select(F.col("path").alias("name"), "length",
                    F.col("modificationTime").alias("modified")))


def _digests(spark: SparkSession, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], "name string, digest string")
    return spark.read.format("binaryFile").load(names).select(
        F.col("path").alias("name"), F.sha2("content", 256).alias("digest"))


def _compared(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every file with its ledger entry and a ``state``: new, touched, gone or same."""
    old = ledger.select("name", F.col("length").alias("_length"), F.col("modified").alias(
        "_modified"), F.col("digest").alias("_digest"), F.col("part").alias("_part"))
    state = (F.when(F.col("_part").isNull(), "new").when(F.col("length").isNull(), "gone")
             .when((F.col("length") != F.col("_length")) | (F.col("modified") != F.col("_modified")),
                   "touched").otherwise("same"))
    return files.join(old, "name", "full").withColumn("state", state)


def follow(spark: SparkSession, folder: str, root: str, read: Read, name: str = "rows"
           ) -> dict[str, int]:
    """Bring the published rows up to date with a folder; how many files were in each state.

    ``read(spark, names)`` gives the rows of some files, with all columns of the table.
    ``changed`` are rewritten files, ``touched`` those whose content is the same.
    """
    after = published.version(spark, root)
    old = after.tables if after else {}
    ledger = (published.table(spark, old["ledger"]) if "ledger" in old
              else spark.createDataFrame([], LEDGER))
    compared = staged(_compared(listing(spark, folder), ledger), "files")
    # Names of files that came or changed; Spark's reader takes them as a list as well.
    names = [r[0] for r in compared.filter("state in ('new', 'touched')").select("name").collect()]
    known = staged(compared.join(_digests(spark, names), "name", "left").withColumn(
        "state", F.when((F.col("state") == "touched") & (F.col("digest") != F.col("_digest")),
                        "changed").otherwise(F.col("state"))), "ledger")
    counts = {r["state"]: r["count"] for r in known.groupBy("state").count().collect()}
    if after and not set(counts) - {"same"}:
        discard(compared, known)
        return counts
    part = f"{after.number + 1 if after else 1:012d}"
    stale = known.filter("state in ('changed', 'gone')")
    rows = _rows(spark, root, old.get(name), stale, part, read,
                 [r[0] for r in known.filter("state in ('new', 'changed')").select("name").collect()])
    fresh = F.col("state").isin("new", "changed")
    entries = known.filter("state <> 'gone'").select(
        "name", "length", "modified", F.coalesce("digest", "_digest").alias("digest"),
        F.when(fresh, F.lit(part)).otherwise(F.col("_part")).alias("part"))
    published.publish(spark, root, {name: rows, "ledger": published.written(entries, root)}, after)
    discard(compared, known)
    return counts


def _rows(spark: SparkSession, root: str, stored: Stored | None, stale: DataFrame, part: str,
          read: Read, names: list[str]) -> Stored:
    """The stored rows without those of stale files, with those of ``names`` as a new part."""
    parts, schema = dict(stored.parts) if stored else {}, stored.schema if stored else None
    touched = sorted(r[0] for r in stale.select("_part").distinct().collect()
                     if r[0] in parts)
    if touched:
        held = published.table(spark, stored, touched, part="_in")
        kept = held.join(stale.select(F.col("name").alias("_file")), "_file", "left_anti")
        rewritten = published.written(kept.select(*stored.columns.names, "_in"), root, "_in").parts
        parts = {p: f for p, f in parts.items() if p not in touched} | rewritten
    if names:
        rows = read(spark, names)
        fresh = published.written(rows.select("*", F.col("_metadata.file_path").alias("_file")),
                                  root, name=part)
        parts, schema = parts | fresh.parts, fresh.schema
    if schema is None:
        schema = read(spark, []).withColumn("_file", F.lit("")).schema.jsonValue()
    return Stored(schema, parts)


def rows(spark: SparkSession, root: str, name: str = "rows") -> DataFrame:
    """The published rows, without the column that names their file."""
    return published.read(spark, root, name).drop("_file")
