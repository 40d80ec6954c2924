"""Distance and containment joins on a grid."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.functions import geo
from loopweave.session import staged


#: Rows of the left side in one cell from which on the cell is dealt to several tasks.
CROWDED = 100_000


def _spread(lat: Column, size: float) -> Column:
    """Degrees of longitude that a circle of ``size`` degrees of latitude reaches."""
    narrow = F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + size)))
    return F.least(F.lit(180.0), F.lit(size) / F.greatest(F.lit(1e-9), narrow)) * 1.000001


def near_join(left: DataFrame, right: DataFrame, metres: float, same: dict[str, str] | None = None,
              how: str = "left", left_at=("latitude", "longitude"),
              right_at=("latitude", "longitude"), suffix: str = "_r",
              crowded: int | None = CROWDED) -> DataFrame:
    """Join rows closer than ``metres`` that also agree on the ``same`` columns.

    Every right row is listed in all grid cells its circle touches, every left
    row in its own cell, so the join is an equality on cell and columns with the
    exact distance as residual, and a pair can meet once only. Right columns
    get ``suffix``; the distance is added as ``metres``, null without a match.
    Circles that cross the 180th meridian are listed on both sides of it, and
    near a pole a circle covers every longitude it reaches.

    A cell (with its ``same`` values) that holds more than ``crowded`` left rows is
    split into slots of about that many: left rows are dealt over the slots, the
    right rows of that cell are copied to each. Any density is many tasks then, also
    that of one single place. Cells are counted in a pass of its own over the left
    coordinates; ``crowded=None`` saves it where no cell can be crowded.
    """
    same = same or {}
    size = metres / geo.METRES_PER_DEGREE
    lat, lon = (F.col(f"{c}{suffix}") for c in right_at)
    reach = _spread(lat, size)

    def cells(x: Column) -> Column:
        inside = geo.cells_around(x, reach, size)
        edge = math.floor(-180 / size), math.floor(180 / size)
        return F.filter(inside, lambda c: c.between(*edge))

    # Few circles cross the meridian: only those list the images of their place one turn away.
    crosses = F.abs(lon) + reach > 180
    columns = F.when(crosses, F.array_distinct(F.flatten(F.array(
        cells(lon), cells(lon - 360), cells(lon + 360))))).otherwise(
            geo.cells_around(lon, reach, size))
    renamed = right.select(*[F.col(c).alias(f"{c}{suffix}") for c in right.columns])
    # Slightly wider than the circle, against rounding at cell edges.
    covered = (renamed
               .withColumn("_cy", F.explode(geo.cells_around(lat, size * 1.000001, size)))
               .withColumn("_cx", F.explode(columns)))
    located = (left.withColumn("_ly", geo.cell(F.col(left_at[0]), size))
               .withColumn("_lx", geo.cell(F.col(left_at[1]), size)))
    away = geo.distance_m(F.col(left_at[0]), F.col(left_at[1]), lat, lon)
    condition = (F.col("_ly") == F.col("_cy")) & (F.col("_lx") == F.col("_cx"))
    for mine, theirs in same.items():
        condition = condition & (F.col(mine) == F.col(f"{theirs}{suffix}"))
    if crowded is not None:
        located, covered = _dealt(located, covered, same, suffix, crowded)
        condition = condition & (F.col("_slot") == F.col("_copy"))
    # Spark takes a table that lists its rows in many cells for as small as before, and
    # would collect it at the driver to broadcast it. So it is always shuffled.
    joined = located.join(covered.hint("merge"), condition & (away < metres), how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*left.columns)
    return joined.select(*left.columns, *renamed.columns, away.alias("metres"))


def _dealt(located: DataFrame, covered: DataFrame, same: dict[str, str], suffix: str, crowded: int
           ) -> tuple[DataFrame, DataFrame]:
    """The left side with a ``_slot``, the right side copied once for each slot of its cell."""
    keys = {"_ly": "_cy", "_lx": "_cx"} | {m: f"{r}{suffix}" for m, r in same.items()}
    busy = (located.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > crowded)
            .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                    F.ceil(F.col("_n") / crowded).alias("_slots")))

    def with_slots(df: DataFrame, columns: list[str]) -> DataFrame:
        met = F.lit(True)
        for i, c in enumerate(columns):
            met = met & (F.col(c) == F.col(f"_k{i}"))
        return df.join(busy, met, "left").withColumn(
            "_slots", F.coalesce("_slots", F.lit(1).cast("long"))).drop(
                *[f"_k{i}" for i in range(len(keys))])

    dealt = with_slots(located, list(keys)).withColumn("_slot", F.pmod(F.xxhash64(
        F.monotonically_increasing_id()), F.col("_slots"))).drop("_slots")
    copied = with_slots(covered, list(keys.values())).withColumn("_copy", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("_slots") - 1))).drop("_slots")
    return dealt, copied


def within(points: DataFrame, latitude: float, longitude: float, metres: float) -> DataFrame:
    """Rows closer than ``metres`` to one place; a box first, so the scan can prune.

    The box goes on beyond the 180th meridian, and has no sides where the circle
    reaches a pole.
    """
    lat_reach = metres / geo.METRES_PER_DEGREE * 1.000001
    box = F.col("latitude").between(latitude - lat_reach, latitude + lat_reach)
    highest = abs(latitude) + lat_reach
    # The meridian that touches the circle lies at asin(sin r / cos lat).
    ratio = (math.sin(math.radians(lat_reach)) / math.cos(math.radians(latitude))
             if highest < 90 else 1.0)
    if ratio < 1.0:
        reach = math.degrees(math.asin(ratio)) * 1.000001
        turns = [F.col("longitude").between(longitude + turn - reach, longitude + turn + reach)
                 for turn in (0, -360, 360)
                 if longitude + turn - reach <= 180 and longitude + turn + reach >= -180]
        box = box & reduce(lambda a, b: a | b, turns)
    away = geo.distance_m(F.lit(latitude), F.lit(longitude), F.col("latitude"),
                          F.col("longitude"))
    return points.filter(box & (away < metres))


def rectangle_rings(areas: DataFrame, key: str) -> DataFrame:
    """(x0, y0, x1, y1) to closed rings."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    return areas.select(key, F.array(*[
        F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]).alias("ring"))


#: Edges from which on an edge cell is split, and how often an area's square may be quartered.
CELL_EDGES, DEEPEST = 8, 12


def _segments(rings: list[list[dict]]) -> np.ndarray:
    """(ax, ay, bx, by) of all rings of at least four points."""
    parts = [np.array([(p["x"], p["y"]) for p in ring], dtype=float) for ring in rings or []
             if ring and len(ring) >= 4]
    return (np.concatenate([np.hstack([p[:-1], p[1:]]) for p in parts]) if parts
            else np.zeros((0, 4)))


def _touching(e: np.ndarray, x0: float, y0: float, size: float) -> np.ndarray:
    """Which segments touch a closed square: boxes overlap, and not all corners on one side."""
    x1, y1 = x0 + size, y0 + size
    near = ((np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0)
            & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0))
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    sides = np.stack([dx * (y - e[:, 1]) - dy * (x - e[:, 0])
                      for x in (x0, x1) for y in (y0, y1)])
    # Wide enough for rounding: a cell too many costs a ray cast, one too few a point.
    slack = 1e-9 * (np.abs(dx) + np.abs(dy)) * (np.abs(e).max(axis=1) + size)
    return near & (sides.min(axis=0) <= slack) & (sides.max(axis=0) >= -slack)


def _inside(e: np.ndarray, x: float, y: float) -> bool:
    """Even-odd rule, by the same arithmetic as ``geo.crossings``."""
    spans = (e[:, 1] > y) != (e[:, 3] > y)
    s = e[spans]
    return bool(((x < s[:, 0] + (s[:, 2] - s[:, 0]) * (y - s[:, 1]) / (s[:, 3] - s[:, 1])).sum())
                % 2)


def quadtree(rings: list[list[dict]]) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(level, column, row, edges) of an area's cells, of side ``2 ** -level``.

    Cells without an edge are inside (``edges`` is None) or left out. A cell with a few
    edges lists those that a ray to the right from any of its points may cross; one
    with more is split into sixteen. So cells are small only along the outline, and
    their number follows its edges.
    """
    e = _segments(rings)
    if not len(e) or not np.isfinite(e).all():
        return
    low = np.minimum(e[:, :2], e[:, 2:]).min(axis=0)
    high = np.maximum(e[:, :2], e[:, 2:]).max(axis=0)
    extent = float((high - low).max())
    if extent <= 0:
        return
    top = -math.ceil(math.log2(extent))
    first, last = (np.floor(c * 2.0 ** top).astype(int) for c in (low, high))
    level_edges = e[e[:, 1] != e[:, 3]]  # level ones are never crossed
    stack = [(top, int(i), int(j), np.arange(len(e))) for i in range(first[0], last[0] + 1)
             for j in range(first[1], last[1] + 1)]
    while stack:
        level, i, j, some = stack.pop()
        size = 2.0 ** -level
        x0, y0 = i * size, j * size
        some = some[_touching(e[some], x0, y0, size)]
        if not len(some):
            if _inside(e, x0 + size / 2, y0 + size / 2):
                yield level, i, j, None
        elif len(some) <= CELL_EDGES or level >= top + DEEPEST:
            r = level_edges
            crossed = ((np.minimum(r[:, 1], r[:, 3]) <= y0 + size)
                       & (np.maximum(r[:, 1], r[:, 3]) >= y0)
                       & (np.maximum(r[:, 0], r[:, 2]) >= x0))
            yield level, i, j, r[crossed]
        else:
            stack += [(level + 2, 4 * i + a, 4 * j + b, some) for a in range(4) for b in range(4)]


_CELLS = "level int, cx long, cy long, edges array<struct<ax: double, ay: double, bx: double, by: double>>"


def area_cells(areas: DataFrame, key: str) -> DataFrame:
    """(_area, level, cx, cy, edges): the quadtree cells of every area; null edges mean inside.

    ``areas`` has ``rings`` (outlines and holes of all its parts), or a single ``ring``.
    """
    rings = F.col("rings") if "rings" in areas.columns else F.array("ring")
    rows = areas.select(F.col(key).alias("_area"), rings.alias("rings"))
    kind = rows.schema["_area"].dataType.simpleString()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")]))
        for batch in batches:
            for n in range(batch.num_rows):
                found = list(quadtree(batch.column(1)[n].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[n].as_py()] * len(found), batch.column(0).type),
                     *[pa.array([c[i] for c in found], t) for i, t in enumerate(
                         (pa.int32(), pa.int64(), pa.int64()))],
                     pa.array([None if c[3] is None else [dict(zip(("ax", "ay", "bx", "by"), s))
                                                          for s in c[3].tolist()]
                               for c in found], edge)],
                    ["_area", "level", "cx", "cy", "edges"])

    return rows.mapInArrow(cells, f"_area {kind}, {_CELLS}")


def containing_area(points: DataFrame, areas: DataFrame, key: str, out: str) -> DataFrame:
    """Add the smallest ``key`` among the areas that contain each point.

    Areas have ``rings``: outlines and holes of all their parts, together by the
    even-odd rule; or a single ``ring``. Distinct coordinates are resolved once: each
    looks up its cell on every level that the areas use. In an inside cell it needs
    no test; in an edge cell it crosses the few edges listed there. Points without
    coordinates or outside all areas get null.
    """
    cells = staged(area_cells(areas, key), "cells")
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # some ten, at most
    places = points.select(F.col("longitude").alias("_x"), F.col("latitude").alias("_y")).dropna()
    sought = places.distinct().select("_x", "_y", F.explode(F.array(*[F.struct(
        F.lit(level).alias("level"), F.floor(F.col("_x") * 2.0 ** level).alias("cx"),
        F.floor(F.col("_y") * 2.0 ** level).alias("cy")) for level in sorted(levels)]).cast(
            "array<struct<level:int,cx:bigint,cy:bigint>>")).alias("c")).select("_x", "_y", "c.*")
    found = (sought.join(cells, ["level", "cx", "cy"])
             .filter(F.col("edges").isNull() | geo.crossings(F.col("_x"), F.col("_y"),
                                                             F.col("edges")))
             .groupBy("_x", "_y").agg(F.min("_area").alias(out)))
    return (points.join(found, (F.col("longitude") == F.col("_x"))
                        & (F.col("latitude") == F.col("_y")), "left")
            .select(*points.columns, out))
