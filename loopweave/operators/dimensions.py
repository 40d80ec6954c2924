"""Star-schema building blocks: versions, surrogate ids, lookups, interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopweave.session import staged


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key in the given order; ties go by the other columns.

    A sort-based aggregate rather than a ranking: copies of a hot key collapse to
    one row per task before the shuffle, so no task ever receives them all. Null
    order values come first.
    """
    payload = [c for c in df.columns if c not in keys]
    ranked = order + [c for c in payload if c not in order]
    return (df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in payload])
            .select(*df.columns))


def station_history(versions: DataFrame, key: str, start: str, end: str = "eff_end",
                    tie_break: list[str] | None = None) -> DataFrame:
    """Validity intervals ``[start, end)``; the newest version of a key stays open.

    One row per (key, start) survives first. ``start`` is a date, so the window
    below holds at most one row per calendar day of a single sensor.
    """
    unique = first_per_key(versions, [key, start], tie_break or [])
    following = Window.partitionBy(key).orderBy(start)
    return unique.withColumn(end, F.lead(start).over(following))


def ordered_ids(df: DataFrame, keys: list[str], out: str = "id",
                nulls_last: bool = False) -> DataFrame:
    """Dense ids 1..n over all rows, null keys included, in the order of ``keys``.

    Rows are range-partitioned on the whole key, so the number of ranges follows
    the data and a hot leading value spreads over many of them. Rows are counted
    inside their range; the counts, one for each range, become offsets.
    """
    order = [F.col(k).asc_nulls_last() if nulls_last else F.col(k).asc_nulls_first()
             for k in keys]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Range number in the upper 31 bits, row number in the lower 33.
    tagged = staged(ranged.withColumn("_at", F.monotonically_increasing_id()).select(
        *df.columns, F.shiftright("_at", 33).alias("_range"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), "ranges")
    counts = tagged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return tagged.join(offsets, "_range").select(
        *df.columns, (F.col("_base") + F.col("_row") + 1).alias(out))


def numbered_history(versions: DataFrame, key: str, start: str, end: str = "eff_end",
                     tie_break: list[str] | None = None, out: str = "id") -> DataFrame:
    """``station_history`` with dense ids in the order (sensor, start)."""
    return ordered_ids(station_history(versions, key, start, end, tie_break), [key, start], out)


def dense_ids(df: DataFrame, keys: list[str], out: str = "id") -> DataFrame:
    """Dense ids 1..n for rows that are unique on ``keys``, in key order."""
    return ordered_ids(df, keys, out)


def dimension(df: DataFrame, natural_key: list[str], extra: list[str] | None = None,
              out: str = "id") -> DataFrame:
    """Distinct natural keys of a feed, with dense ids."""
    columns = natural_key + (extra or [])
    rows = df.select(*columns).dropna(how="all", subset=natural_key)
    unique = (first_per_key(rows, natural_key, extra) if extra
              else rows.dropDuplicates(natural_key))
    return dense_ids(unique, natural_key, out)


def lookup(df: DataFrame, table: DataFrame, on: dict[str, str], take: dict[str, str],
           how: str = "inner", default=None) -> DataFrame:
    """Replace natural keys by columns of a lookup table.

    ``on`` maps fact columns to lookup columns, ``take`` lookup columns to output
    names. No broadcast hint: Spark broadcasts below its size threshold and
    shuffles beyond it.
    """
    right = table.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())],
                         *[F.col(c).alias(f"_v_{name}") for c, name in take.items()])
    condition = F.lit(True)
    for i, left in enumerate(on):
        condition = condition & (df[left] == F.col(f"_k{i}"))
    joined = df.join(right, condition, how)
    taken = []
    for name in take.values():
        value = F.col(f"_v_{name}")
        taken.append((value if default is None else F.coalesce(value, F.lit(default))).alias(name))
    return joined.select(*df.columns, *taken)


def placed(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose looked-up ids are all there, the others), after left lookups."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(c).isNotNull()
    return df.filter(found), df.filter(~found)


def version_at(facts: DataFrame, history: DataFrame, key: str, day: str, version_key: str,
               start: str = "eff_start", end: str = "eff_end", version_id: str = "id",
               out: str = "station_version", default: int = -1) -> DataFrame:
    """The version valid on ``day``: start <= day < end, or no end. None gives ``default``.

    An equi-join on the sensor with the interval as residual. Intervals of one
    sensor do not overlap, so a fact meets at most one version and keeps its
    place: the facts are read once. A small history is broadcast by Spark; a
    large one is shuffled, where AQE splits a hot sensor's readings.
    """
    versions = history.select(F.col(version_key).alias("_vkey"), F.col(start).alias("_from"),
                              F.col(end).alias("_to"), F.col(version_id).alias("_vid"))
    valid = (
        (F.col(key) == F.col("_vkey")) & (F.col("_from") <= F.col(day))
        & (F.col("_to").isNull() | (F.col(day) < F.col("_to")))
    )
    return facts.join(versions, valid, "left").select(
        *facts.columns, F.coalesce("_vid", F.lit(default)).alias(out))


def matched(df: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose foreign key exists in ``parent``."""
    return _by_key(df, parent, on, "left_semi")


def unmatched(df: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose foreign key is missing from ``parent`` or null."""
    return _by_key(df, parent, on, "left_anti")


def with_match(df: DataFrame, parent: DataFrame, on: dict[str, str], out: str) -> DataFrame:
    """Add whether the foreign key exists in ``parent``; false for a null key. One scan of both."""
    keys = parent.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())]).distinct()
    condition = F.lit(True)
    for i, left in enumerate(on):
        condition = condition & (df[left] == F.col(f"_k{i}"))
    return df.join(keys, condition, "left").select(
        *df.columns, F.col("_k0").isNotNull().alias(out))


def _by_key(df: DataFrame, parent: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    keys = parent.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())])
    condition = F.lit(True)
    for i, left in enumerate(on):
        condition = condition & (df[left] == F.col(f"_k{i}"))
    return df.join(keys, condition, how)


def update_by_key(df: DataFrame, changes: DataFrame, on: dict[str, str],
                  take: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Set columns from a change table where the key matches; otherwise the defaults.

    Several changes of one key count as one: the first in the order of ``take``,
    so a row is never multiplied.
    """
    defaults = defaults or {}
    single = first_per_key(changes.select(*on.values(), *[c for c in take if c not in on.values()]),
                           [*on.values()], [c for c in take if c not in on.values()])
    joined = lookup(df.drop(*take.values()), single, on, take, "left")
    kept = [c for c in joined.columns if c not in take.values()]
    filled = [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if defaults.get(c) is not None
              else F.col(c) for c in take.values()]
    return joined.select(*kept, *filled)
