"""Distances, grid cells and containment on plain latitude/longitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null where a coordinate is."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # ``least`` skips nulls, so a missing coordinate is kept out of it.
    return F.when(chord.isNotNull(), F.lit(2 * EARTH_RADIUS_M) * F.asin(
        F.sqrt(F.least(F.lit(1.0), chord))))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def cells_around(value: Column, reach: Column | float, size: float) -> Column:
    """All cells that a span of ``reach`` on both sides of ``value`` touches."""
    reach = F.lit(reach) if isinstance(reach, (int, float)) else reach
    return F.sequence(cell(value - reach, size), cell(value + reach, size))


def crossings(x: Column, y: Column, edges: Column) -> Column:
    """Does a ray to the right of (x, y) cross an odd number of the (ax, ay, bx, by) structs?"""

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        # try_divide: a level edge never spans, but ANSI mode would still divide.
        return spans & (x < e["ax"] + F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]),
                                                   e["by"] - e["ay"]))

    return F.aggregate(edges, F.lit(False), lambda inside, e: inside != F.coalesce(
        crosses(e), F.lit(False)))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: is (x, y) inside a closed ring of (x, y) structs?"""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
                       lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"),
                                             b["x"].alias("bx"), b["y"].alias("by")))
    return F.when(F.size(ring) >= 4, crossings(x, y, edges)).otherwise(F.lit(False))
