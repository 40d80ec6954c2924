"""Loads that are all or nothing: written aside, audited, published by one rename.

A publication is a folder. Every load writes Parquet folders of its own below
``data`` and, when everything passed, one small JSON file ``versions/<n>.json``
that names the folders of each table. Readers open the largest version. So a load
that fails anywhere leaves what was published; a reader that has started keeps
its folders; and of two loads that publish the same version, one is refused.

A table consists of named parts. A load may replace some parts and keep the
folders of the others, so it rewrites only what it touches. ``notes`` holds a few
values of the load, such as the largest id given out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopweave.session import remove

WHOLE = "whole"


class AuditFailed(Exception):
    """A table broke a rule before it was published."""


class Conflict(Exception):
    """Another load published first."""


@dataclass(frozen=True)
class Stored:
    """A table of a version: its schema and the folder of every part."""

    schema: dict
    parts: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    @property
    def columns(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, Stored]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _version_file(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/versions/{number:012d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The published version numbers, ascending."""
    folder = f"{root.rstrip('/')}/versions"
    files = _file_system(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(_path(spark, folder))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """A version, by default the current one; None if nothing was published."""
    if number is None:
        found = numbers(spark, root)
        if not found:
            return None
        number = found[-1]
    text = spark.read.text(_version_file(root, number), wholetext=True).first()[0]
    made = json.loads(text)
    return Version(number, {name: Stored(**t) for name, t in made.items()})


def table(spark: SparkSession, stored: Stored, parts: list[str] | None = None,
          part: str | None = None) -> DataFrame:
    """The rows of a stored table, of all its parts or of the named ones.

    With ``part``, a column of that name tells which part a row is in.
    """
    chosen = {p: stored.parts[p] for p in (stored.parts if parts is None else parts)
              if p in stored.parts}
    if not chosen:
        rows = spark.createDataFrame([], stored.columns)
        return rows.withColumn(part, F.lit("")) if part else rows
    rows = spark.read.schema(stored.columns).parquet(*chosen.values())
    if not part:
        return rows
    # The folder of a file names its part; there are few, so the map is a small constant.
    names = F.create_map(*[F.lit(x) for p, folder in chosen.items()
                           for x in (_last(folder), p)])
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.withColumn(part, names[folder])


def read(spark: SparkSession, root: str, name: str, at: Version | None = None,
         parts: list[str] | None = None, part: str | None = None) -> DataFrame:
    """A table of the current version, or of ``at``; see ``table``."""
    current = at or version(spark, root)
    if current is None or name not in current.tables:
        raise FileNotFoundError(f"{root} has no published table {name}")
    return table(spark, current.tables[name], parts, part)


def _last(folder: str) -> str:
    return folder.rstrip("/").rsplit("/", 1)[-1]


def aside(root: str) -> str:
    """A new folder for the data of a load."""
    return f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"


def written(df: DataFrame, root: str, part: str | None = None, name: str = WHOLE) -> Stored:
    """Write a table aside, as one part called ``name``. Nobody sees it yet.

    Or in several: ``part`` is a column that names the part of every row; it is not kept.
    """
    spark, folder = df.sparkSession, aside(root)
    if part is None:
        df.write.parquet(folder)
        return Stored(df.schema.jsonValue(), {name: folder})
    kept = df.drop(part)
    # Folder names are unique over all loads, since they name the part in ``read``.
    tag = _last(folder)[:12]
    df.withColumn("_folder", F.concat(F.lit(f"{tag}-"), F.col(part))).drop(part).write.partitionBy(
        "_folder").parquet(folder)
    made = [s.getPath().getName() for s in _file_system(spark, folder).listStatus(
        _path(spark, folder)) if s.isDirectory()]
    parts = {n.split("=", 1)[1][len(tag) + 1:]: f"{folder}/{n}"
             for n in made if n.startswith("_folder=")}
    return Stored(kept.schema.jsonValue(), parts)


def publish(spark: SparkSession, root: str, tables: dict[str, Stored],
            after: Version | None, keep_others: bool = True) -> Version:
    """Make the tables current, in one step; tables that are not named stay as they are.

    ``after`` is the version the load has read (None for the first one). If another
    load has published since, ``Conflict`` is raised and nothing changes.
    """
    number = after.number + 1 if after else 1
    rest = dict(after.tables) if after and keep_others else {}
    made = Version(number, rest | tables)
    text = json.dumps({name: {"schema": t.schema, "parts": t.parts, "notes": t.notes}
                       for name, t in made.tables.items()})
    final = _version_file(root, number)
    unseen = f"{root.rstrip('/')}/versions/.{uuid.uuid4().hex}"
    files = _file_system(spark, final)
    files.mkdirs(_path(spark, final).getParent())
    out = files.create(_path(spark, unseen), False)
    out.write(bytearray(text.encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    none[0] = fs.Options.Rename.NONE  # never over an existing file
    try:
        fs.FileContext.getFileContext(_path(spark, final).toUri(),
                                      spark._jsc.hadoopConfiguration()).rename(
            _path(spark, unseen), _path(spark, final), none)
    except Exception as error:
        remove(spark, unseen)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version {number} of {root} was published by another load") from None
        raise
    return made


Audit = Callable[[DataFrame], str | None]


def not_empty(rows: DataFrame) -> str | None:
    return "no rows" if rows.isEmpty() else None


def unique(*keys: str) -> Audit:
    """An audit: no two rows agree in ``keys``."""

    def check(rows: DataFrame) -> str | None:
        twice = rows.groupBy(*keys).count().filter("count > 1")
        return None if twice.isEmpty() else f"repeated {', '.join(keys)}"

    return check


def complete(*columns: str) -> Audit:
    """An audit: no null in ``columns``."""

    def check(rows: DataFrame) -> str | None:
        missing = rows.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
        bad = [c for c in columns if missing[c]]
        return f"nulls in {', '.join(bad)}" if bad else None

    return check


def load(spark: SparkSession, root: str, tables: dict[str, DataFrame],
         audits: dict[str, list[Audit]] | None = None) -> Version:
    """Replace whole tables together, or none of them.

    Each is written aside and its audits see what was written. If a job or an audit
    fails, what was written goes and the published version stays.
    """
    after, made, folders = version(spark, root), {}, []
    try:
        for name, df in tables.items():
            folder = aside(root)
            folders.append(folder)
            df.write.parquet(folder)
            made[name] = Stored(df.schema.jsonValue(), {WHOLE: folder})
            rows = spark.read.schema(df.schema).parquet(folder)
            for audit in (audits or {}).get(name, []):
                fault = audit(rows)
                if fault:
                    raise AuditFailed(f"{name}: {fault}")
        return publish(spark, root, made, after)
    except Exception:
        for folder in folders:
            remove(spark, folder)
        raise


def forget(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` versions and the folders that only they name."""
    found = numbers(spark, root)
    old, kept = found[:-keep], [version(spark, root, n) for n in found[-keep:]]
    if not old:
        return 0
    used = {folder for v in kept for t in v.tables.values() for folder in t.parts.values()}
    gone = {folder for n in old for t in version(spark, root, n).tables.values()
            for folder in t.parts.values()} - used
    for number in old:
        remove(spark, _version_file(root, number))
    for folder in gone:
        remove(spark, folder)
    return len(gone)
