"""Dimensions that grow by loads: ids stay, and only what a load touches is rewritten.

Both kinds live in a publication (``sources.published``). The functions here write
the new state aside and return its description; the load publishes the tables of
all its dimensions together.

A station history has hash ranges of the sensor as its parts. A snapshot (new
versions of some sensors, or a whole feed again) is merged into it: versions that
are new get the next ids, in the order (sensor, start); versions that are known
keep theirs for good, so stored facts keep pointing at them; the version before a
new one is closed, the one after gives its end. Parts whose versions do not
change are neither written nor moved.

A version that is known may come again with other attributes. The first row in
the order of ``tie_break``, then of the other columns, stays, whichever load it
came with, so that loading A and then B gives the intervals of A and B together.

Defined cases: rows without a sensor or a start are no versions and are left out
(a load's rules report them); a snapshot without news changes nothing, and the
stored table is returned as it is; an empty first load makes an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopweave.operators.dimensions import first_per_key, ordered_ids
from loopweave.session import discard, staged
from loopweave.sources import published
from loopweave.sources.published import Stored

PARTS = 64  # hash ranges of the sensor


def _part(key: str, parts: int):
    return F.format_string("%05d", F.pmod(F.xxhash64(key), F.lit(parts)))


def merged_history(spark: SparkSession, root: str, stored: Stored | None, snapshot: DataFrame,
                   key: str = "sensor_id", start: str = "eff_start", end: str = "eff_end",
                   out: str = "id", tie_break: list[str] | None = None, parts: int = PARTS
                   ) -> Stored:
    """A stored history with a snapshot merged into it.

    The history has ``out``, the snapshot's columns and ``end``. The first load fixes
    the number of parts.
    """
    tie_break = tie_break or []
    order = tie_break + [c for c in snapshot.columns if c not in (key, start, *tie_break)]
    last, parts = (stored.notes["last_id"], stored.notes["parts"]) if stored else (0, parts)
    unique = first_per_key(snapshot.filter(F.col(key).isNotNull() & F.col(start).isNotNull()),
                           [key, start], order)
    brought = staged(unique.withColumn("_part", _part(key, parts)), "snapshot")
    payload = F.struct(*order) if order else F.struct(F.lit(True))
    rows = brought.withColumn(out, F.lit(None).cast("long"))
    if stored:
        named = [r[0] for r in brought.select("_part").distinct().collect()]  # at most ``parts``
        keys = published.table(spark, stored, named).select(
            F.col(key).alias("_k"), F.col(start).alias("_s"), payload.alias("_old"))
        # New, or ahead of what is stored.
        news = brought.withColumn("_new", payload).join(
            keys, (F.col(key) == F.col("_k")) & (F.col(start) == F.col("_s")), "left").filter(
                F.col("_k").isNull() | (F.col("_new") < F.col("_old")))
        touched = sorted(r[0] for r in news.select("_part").distinct().collect())
        if not touched:
            discard(brought)
            return stored
        rows = rows.filter(F.col("_part").isin(touched)).drop("_part").unionByName(
            published.table(spark, stored, touched).select(out, *snapshot.columns))
    # One row for each version: the id it had, and the first of its attributes.
    merged = staged(rows.groupBy(key, start).agg(
        F.max(out).alias(out), F.min(payload).alias("_kept")).select(
            out, key, start, *[F.col("_kept")[c].alias(c) for c in order]), "versions")
    fresh = merged.filter(F.col(out).isNull()).select(key, start)
    numbered = merged.join(ordered_ids(fresh, [key, start], "_new"), [key, start], "left").withColumn(
        out, F.coalesce(F.col(out), F.col("_new") + F.lit(last))).drop("_new")
    # At most one row for each calendar day of a sensor.
    following = Window.partitionBy(key).orderBy(start)
    history = numbered.withColumn(end, F.lead(start).over(following)).select(
        out, *snapshot.columns, end)
    made = published.written(history.withColumn("_part", _part(key, parts)).repartition("_part"),
                             root, "_part")
    notes = {"last_id": last + fresh.count(), "parts": parts}
    discard(brought, merged)
    kept = {p: f for p, f in (stored.parts if stored else {}).items() if p not in made.parts}
    return Stored(made.schema, kept | made.parts, notes)


def merged_dimension(spark: SparkSession, root: str, stored: Stored | None, rows: DataFrame,
                     natural_key: list[str], extra: list[str] | None = None, out: str = "id"
                     ) -> Stored:
    """A stored dimension with the natural keys of ``rows`` that it lacks; they get the next ids.

    New keys are a part of their own; what is stored is neither read whole nor
    rewritten. ``extra`` columns are those of the first load that brought the key.
    """
    columns = natural_key + (extra or [])
    last = stored.notes["last_id"] if stored else 0
    named = rows.select(*columns).dropna(how="all", subset=natural_key)
    unique = (first_per_key(named, natural_key, extra) if extra
              else named.dropDuplicates(natural_key))
    if stored:
        known = published.table(spark, stored).select(
            *[F.col(c).alias(f"_k{i}") for i, c in enumerate(natural_key)])
        same = F.lit(True)
        for i, c in enumerate(natural_key):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        unique = unique.join(known, same, "left_anti")
    fresh = staged(unique, "keys")
    count = fresh.count()
    if stored and not count:
        discard(fresh)
        return stored
    numbered = ordered_ids(fresh, natural_key, "_new").select(
        (F.col("_new") + F.lit(last)).alias(out), *columns)
    made = published.written(numbered, root, name=f"from{last + 1:012d}")
    discard(fresh)
    return Stored(made.schema, (stored.parts if stored else {}) | made.parts,
                  {"last_id": last + count})


def merge_history(spark: SparkSession, root: str, snapshot: DataFrame,
                  name: str = "traffic_station", **how) -> published.Version:
    """Merge a snapshot into the published history ``name``; the version that holds it."""
    after = published.version(spark, root)
    stored = after.tables.get(name) if after else None
    made = merged_history(spark, root, stored, snapshot, **how)
    return after if made is stored else published.publish(spark, root, {name: made}, after)


def moved(before: DataFrame, after: DataFrame, out: str = "id", end: str = "eff_end") -> DataFrame:
    """(id, old end, new end) of the versions that a load closed or shortened.

    Facts on days from the new end on may now belong to a later version.
    """
    old = before.select(out, F.col(end).alias("old_end"))
    return after.select(out, F.col(end).alias("new_end")).join(old, out).filter(
        ~F.col("old_end").eqNullSafe(F.col("new_end"))).select(out, "old_end", "new_end")


def facts_to_move(facts: DataFrame, ends: DataFrame, day: str, version: str = "station_version",
                  out: str = "id") -> DataFrame:
    """Stored facts whose version no longer covers their day, after ``moved`` ends.

    An equi-join on the version; few versions move in a load, so Spark usually
    broadcasts them.
    """
    return facts.join(ends.select(F.col(out).alias(version), "new_end"), version).filter(
        F.col(day) >= F.col("new_end")).select(*facts.columns)
