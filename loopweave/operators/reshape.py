"""Long to fixed-slot profiles and back, unpivots, one-hot columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopweave.schemas import wide_columns

# Conditional aggregates per row group; keeps generated code below the method limit.
_CELLS_PER_GROUP = 72
# Readings that a task packs at once, some tens of megabytes.
_PACKED = 500_000
# Parts of a shuffle of packed readings for each one that is configured: unpacked, with their
# cells, they take about eight times their size in the shuffle.
_PARTS = 4


def slot_profiles(readings: DataFrame, keys: list[str], slot: str, measures: list[str],
                  slots: int = 288, how: str = "max", strict: bool = True,
                  time: str | None = None, bad: str | None = None) -> DataFrame:
    """One row per key with an ``array<double>`` of length ``slots`` per measure.

    The day is cut into blocks of neighbouring slots, and one shuffle brings a key
    together. Where one block holds all cells, readings collapse on the map side, so
    a hot key shrinks before it. Else tasks pack the readings of a key into arrays
    and hold no cells, so the map side needs a bounded amount of memory; blocks are
    made and joined where the key has come to.

    Readings outside the slots 0 .. ``slots`` - 1 belong to no cell and are left out.
    ``strict`` drops a key with an empty slot or a ``bad`` reading; otherwise
    empty cells become 0. ``how`` is ``max``, ``avg`` or ``first`` (earliest
    ``time``) for several readings in one slot.
    """
    width = max(1, min(slots, _CELLS_PER_GROUP // len(measures)))
    blocks = -(-slots // width)
    offset = F.col(slot) % width

    def cell(measure: str, position: int) -> Column:
        value = F.when(offset == position, F.col(measure).cast("double"))
        if how == "first":
            return F.min_by(value, F.when(offset == position, F.col(time)))
        return {"max": F.max, "avg": F.avg}[how](value)

    flag = F.coalesce(F.col(bad), F.lit(False)) if bad else F.lit(False)
    cells = [cell(m, p).alias(f"_{m}_{p}") for m in measures for p in range(width)]
    # Missing cells are counted or filled here, where the cells are still plain columns.
    filled = [F.col(c) if strict else F.coalesce(F.col(c), F.lit(0.0))
              for c in (f"_{m}_{p}" for m in measures for p in range(width))]
    present = sum((F.col(f"_{m}_{p}").isNotNull().cast("int")
                   for m in measures for p in range(width)), F.lit(0))
    by_block = ["_block"] if blocks > 1 else []
    inside = readings.filter(F.col(slot).between(0, slots - 1))
    if blocks > 1 and keys:
        rest = [slot, *measures, *[c for c in (time if how == "first" else None, bad) if c]]
        inside = _brought_together(inside, keys, [c for c in dict.fromkeys(rest) if c not in keys])
    partial = (
        inside.withColumn("_block", F.floor(F.col(slot) / width).cast("int"))
        .groupBy(*keys, *by_block).agg(F.bool_or(flag).alias("_bad"), *cells)
        .select(*keys, *(by_block or [F.lit(0).alias("_block")]), "_bad", present.alias("_present"), F.struct(*[
            F.array(*filled[i * width:(i + 1) * width]).alias(m)
            for i, m in enumerate(measures)]).alias("_cells"))
    )
    gathered = partial.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_block", "_cells"))).alias("_day"),
        F.bool_or("_bad").alias("_bad"), F.sum("_present").alias("_present"))
    if strict:
        gathered = gathered.filter(~F.col("_bad")
                                   & (F.col("_present") == slots * len(measures)))
    empty = F.array_repeat(F.lit(0.0), width)

    def whole_day(measure: str) -> Column:
        parts = [F.coalesce(F.try_element_at("_day", F.lit(b))[measure], empty)
                 for b in range(blocks)]
        return F.slice(F.concat(*parts), 1, slots)

    return gathered.select(*keys, *[whole_day(m).alias(m) for m in measures])


def _brought_together(rows: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """``keys`` and ``rest`` of all rows, shuffled by ``keys`` and packed on the way.

    Keys of nested types are shuffled row by row.
    """
    rows = rows.select(*keys, *rest)
    fields, n = rows.schema.fields, len(keys)
    if not all(isinstance(f.dataType, T.AtomicType) for f in fields[:n]):
        return rows.repartition(*keys)
    names = [f"c{i}" for i in range(len(fields))]

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).rename_columns(names)
        lists = table.group_by(names[:n], use_threads=False).aggregate([(c, "list") for c in names[n:]])
        yield from lists.select([*names[:n], *[f"{c}_list" for c in names[n:]]]).rename_columns(
            names).to_batches(1000)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= _PACKED:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)

    shape = T.StructType([T.StructField(c, f.dataType if i < n else T.ArrayType(f.dataType))
                          for i, (c, f) in enumerate(zip(names, fields))])
    parts = _PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = rows.mapInArrow(packed, shape).repartition(parts, *names[:n])
    zipped = F.arrays_zip(*[F.col(c).alias(f.name) for c, f in zip(names[n:], fields[n:])])
    return together.select(*[F.col(c).alias(f.name) for c, f in zip(names[:n], fields[:n])],
                           F.inline(zipped))


def spread_slots(profiles: DataFrame, measures: list[str], slots: int = 288) -> DataFrame:
    """Arrays to one column per measure and slot, for export."""
    keys = [c for c in profiles.columns if c not in measures]
    cells = [F.get(m, F.lit(i)).alias(name)
             for m in measures for i, name in enumerate(wide_columns(m, slots))]
    return profiles.select(*keys, *cells)


def select_measure(wide: DataFrame, measure: str, keys: list[str], slots: int = 288) -> DataFrame:
    """Keys and the columns of one measure; fails when the table lacks any of them."""
    wanted = wide_columns(measure, slots)
    present = [c for c in wide.columns if c.startswith(f"{measure}_")]
    if sorted(present) != sorted(wanted):
        raise ValueError(f"expected {slots} columns of {measure}, found {len(present)}")
    return wide.select(*keys, *wanted)


def to_vector(wide: DataFrame, keys: list[str], columns: list[str], out: str) -> DataFrame:
    return wide.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def unpivot_months(wide: DataFrame, key: str, first_year: int = 2008) -> DataFrame:
    """Month columns (``2008-01`` or ``m2008_01``) to rows (key, month, value)."""
    found = {c: re.fullmatch(r"m?([0-9]{4})[-_]([0-9]{2})", c) for c in wide.columns}
    months = [c for c, m in found.items() if m and int(m.group(1)) >= first_year]
    if not months:
        raise ValueError("no month columns")
    text = F.regexp_replace(F.regexp_replace("label", "^m", ""), "_", "-")
    typed = wide.select(key, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in months])
    return (typed.unpivot(key, [f"`{c}`" for c in months], "label", "value")
            .select(key, F.to_date(F.concat(text, F.lit("-01"))).alias("month"), "value"))


def one_hot(df: DataFrame, column: str, values: list | None = None, most: int = 2000) -> DataFrame:
    """Replace a column by one 0/1 column per value.

    Values found in the data become columns, so there must be few of them: more
    than ``most`` is an error, never a silent cut.
    """
    if values is None:
        rows = df.select(column).dropna().distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{column} has more than {most} values")
        values = sorted(r[0] for r in rows)
    flags = [F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("double")
             .alias(f"Field_sourceCol_{column}_value_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != column], *flags)


def explode_precipitation(records: DataFrame, values: str = "values",
                          declared: str = "value_count") -> DataFrame:
    """``HHMM amount[flag][flag] ...`` to one row per reading.

    Records whose number of pairs differs from the declared count give no rows;
    ``miscounted_precipitation`` returns those.
    """
    kept = [c for c in records.columns if c not in (values, declared)]
    # The words stay a column of their own, so that a record is split only once.
    words = records.withColumn("_words", F.split(F.trim(values), " +"))
    pairs = F.when(_pairs_fit(declared), F.sequence(F.lit(0), F.col(declared) - 1))
    amount = F.get("_words", F.col("_i") * 2 + 1)
    return words.select(*kept, "_words", F.explode(pairs).alias("_i")).select(
        *kept, F.floor(F.get("_words", F.col("_i") * 2).try_cast("int") / 100).cast("int")
        .alias("hour"),
        F.substring(amount, 1, 5).try_cast("int").alias("amount"),
        F.nullif(F.substring(amount, 6, 1), F.lit("")).alias("flag1"),
        F.nullif(F.substring(amount, 7, 1), F.lit("")).alias("flag2"))


def miscounted_precipitation(records: DataFrame, values: str = "values",
                             declared: str = "value_count") -> DataFrame:
    words = records.withColumn("_words", F.split(F.trim(values), " +"))
    return words.filter(~F.coalesce(_pairs_fit(declared), F.lit(False))).drop("_words")


def _pairs_fit(declared: str) -> Column:
    return (F.size("_words") == F.col(declared) * 2) & (F.col(declared) > 0)


def as_cells(df: DataFrame, row: str, vector: str) -> DataFrame:
    """Matrix rows to (i, j, value) cells."""
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "value"))


def transpose_cells(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def coefficient_columns(projected: DataFrame, k: int, day: Column) -> DataFrame:
    """``V0..V{k-1}`` to an array, and to weekday and weekend arrays."""
    weekend = F.dayofweek(day).isin(1, 7)
    flow = F.array(*[F.col(f"V{i}") for i in range(k)])
    rest = [c for c in projected.columns if not re.fullmatch(r"V[0-9]+", c)]
    return projected.select(*rest, flow.alias("flow_coef"),
                            F.when(~weekend, flow).alias("weekday_coef"),
                            F.when(weekend, flow).alias("weekend_coef"))
