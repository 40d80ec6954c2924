"""Areas, distances and sets against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.functions import geo
from loopweave.operators import distinct_sets, moments, spatial

AREA = "k long, rings array<array<struct<x: double, y: double>>>"
PLACE = "id long, latitude double, longitude double"


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in [*corners, corners[0]]]


def star(rnd, x, y, r, n):
    """A jagged closed outline."""
    return ring(*[(x + r * rnd.uniform(0.4, 1) * math.cos(a), y + r * rnd.uniform(0.4, 1) * math.sin(a))
                  for a in sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))])


def odd(rings, x, y):
    n = 0
    for r in rings or []:
        if r and len(r) >= 4:
            for a, b in zip(r, r[1:]):
                if (a["y"] > y) != (b["y"] > y):
                    n += x < a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"])
    return n % 2 == 1


def test_areas_equal_even_odd_counts(rows):
    rnd = random.Random(3)
    areas = [(1, [star(rnd, 0, 0, 10, 300), star(rnd, 0, 0, 3, 40)]),
             (2, [star(rnd, 8, 8, 4, 9), star(rnd, -30, 4, 0.5, 25), star(rnd, 25, -3, 6, 80)]),
             (3, [ring((-100, -100), (100, -100), (100, 100), (-100, 100))]),
             (4, [star(rnd, 1, 1, 0.001, 30)]), (5, None), (6, []), (7, [[], ring((0, 0), (1, 1))]),
             (0, [ring((5, 5), (6, 5), (6, 6), (5, 6))])]
    places = [(i, rnd.uniform(-14, 14), rnd.uniform(-36, 36)) for i in range(900)]
    places += [(1000 + i, 1 + rnd.uniform(-.001, .001), 1 + rnd.uniform(-.001, .001))
               for i in range(80)]
    # Corners, edges and cell borders.
    places += [(2000 + i, y, x) for i, (x, y) in enumerate(
        [(5.0, 5.0), (6.0, 6.0), (5.5, 5.0), (5.0, 5.5), (6.0, 5.5), (0.0, 0.0), (-100.0, 0.0),
         (100.0, 0.0), (99.9, 99.9)])]
    places += [(3000, None, 1.0), (3001, 1.0, None)]
    got = {r.id: r.a for r in spatial.containing_area(
        rows(PLACE, places), rows(AREA, areas), "k", "a").collect()}
    for i, y, x in places:
        inside = [k for k, rings in areas if x is not None and y is not None and odd(rings, x, y)]
        assert got[i] == (min(inside) if inside else None), (i, x, y)


def test_cells_follow_the_outline():
    rnd = random.Random(1)
    square = list(spatial.quadtree([ring((0, 0), (64, 0), (64, 64), (0, 64))]))
    assert len(square) <= 9

    def coast(n):
        turns = [2 * math.pi * i / n for i in range(n)]
        return ring(*[((10 + math.sin(9 * a)) * math.cos(a), (10 + math.sin(9 * a)) * math.sin(a))
                      for a in turns])

    sizes = {n: len(list(spatial.quadtree([coast(n)]))) for n in (100, 1000, 10_000)}
    assert all(size <= 2 * n for n, size in sizes.items())
    inside = [c for c in spatial.quadtree([star(rnd, 0, 0, 10, 1000)]) if c[3] is None]
    assert len({c[0] for c in inside}) > 1  # of mixed size


def test_empty_areas_and_places(rows):
    places = rows(PLACE, [(1, 0.5, 0.5)])
    assert [r.a for r in spatial.containing_area(places, rows(AREA, []), "k", "a").collect()] == [None]
    areas = rows(AREA, [(1, [ring((0, 0), (1, 0), (1, 1), (0, 1))])])
    assert spatial.containing_area(rows(PLACE, []), areas, "k", "a").collect() == []


# --- distances


def apart(a, b):
    la, lo, lb, mo = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("centre", [(0.0, 179.95), (10.0, -179.99), (89.5, 20.0), (-89.99, 0.0),
                                    (90.0, 0.0), (84.0, 100.0), (32.7, -117.0), (0.0, 0.0)])
@pytest.mark.parametrize("metres", [500.0, 90_000.0, 3_000_000.0])
def test_radius_everywhere(rows, centre, metres):
    rnd = random.Random(9)
    reach = metres / geo.METRES_PER_DEGREE * 1.5
    places = [(i, max(-90.0, min(90.0, centre[0] + rnd.uniform(-reach, reach))),
               (centre[1] + rnd.uniform(-1, 1) * min(180, reach / max(.01, math.cos(math.radians(
                   centre[0])))) + 180) % 360 - 180) for i in range(400)]
    got = {r.id for r in spatial.within(rows(PLACE, places), *centre, metres).collect()}
    assert got == {i for i, y, x in places if apart(centre, (y, x)) < metres}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_crowded_cells_give_the_same_rows(rows, how):
    rnd = random.Random(2)
    left = [(i, 1.0, 1.0, i % 2) for i in range(300)]  # one place
    left += [(300 + i, 1 + rnd.uniform(0, .01), 1 + rnd.uniform(0, .01), 0) for i in range(150)]
    left += [(500 + i, rnd.uniform(-5, 5), rnd.uniform(-5, 5), 1) for i in range(50)]
    left += [(600, None, 1.0, 0), (601, 1.0, 1.0, None)]
    right = [(i, 1 + rnd.uniform(-.02, .02), 1 + rnd.uniform(-.02, .02), i % 2) for i in range(40)]
    schema = PLACE + ", g int"
    plain, dealt = [sorted(map(str, spatial.near_join(
        rows(schema, left), rows(schema, right), 1500, {"g": "g"}, how, crowded=c).collect()))
        for c in (None, 7)]
    assert plain == dealt and plain


@pytest.mark.parametrize("crowded", [None, 1000])
def test_rows_listed_in_cells_are_never_broadcast(rows, crowded):
    """Their estimated size is that of the rows before, so the driver would collect many times that."""
    left = rows(PLACE, [(i, 1.0, 1.0 + i / 1000) for i in range(30)])
    right = rows(PLACE, [(i, 1.0, 1.0) for i in range(3)])
    joined = spatial.near_join(left, right, 20_000, crowded=crowded)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 90 and "rightHint=(strategy=merge)" in plan
    made = joined._jdf.queryExecution().executedPlan().toString()
    met = made.index("Join", made.index("metres"))  # the join of the distance, first below its result
    assert made[:met].endswith("SortMerge")


def test_a_crowded_cell_is_many_tasks(spark):
    """Nine rows of ten in one place: no task of the join gets more than three times the median."""
    n = 20_000
    left = spark.range(n).select("id", F.when(F.col("id") % 10 < 9, 1.0).otherwise(
        F.col("id") / n * 80).alias("latitude"), F.lit(1.0).alias("longitude"))
    right = spark.range(30).select("id", (1 + F.col("id") / 1e5).alias("latitude"),
                                   F.lit(1.0).alias("longitude"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                             "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")

        def sizes(crowded):
            joined = spatial.near_join(left, right, 2000, crowded=crowded)
            found = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("id").alias(
                "n")).collect()
            return sorted(r.n for r in found)

        alone, dealt = sizes(None), sizes(200)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert alone[-1] > 0.9 * n
    assert sum(dealt) == n and dealt[-1] <= 3 * float(np.median(dealt))


# --- sets of ids


def test_sets_equal_sets(rows):
    rnd = random.Random(4)
    data = [(g, rnd.choice([rnd.randrange(-40_000, 40_000), rnd.randrange(200_000), 0, 1, 32768,
                            32769, -32768, 2 ** 40, None])) for g in "ab" for _ in range(500)]
    data += [(None, 5), ("empty", None)]
    sets = distinct_sets.id_sets(rows("g string, v long", data), ["g"], "v")
    want = {}
    for g, v in data:
        if v is not None:
            want.setdefault(g, set()).add(v)
    got = {}
    for r in distinct_sets.pages(sets).orderBy("g", "page").collect():
        assert r.ids == sorted(r.ids) and len(r.ids) == r.n <= distinct_sets.PAGE
        got.setdefault(r.g, []).extend(r.ids)
    assert got == {g: sorted(v) for g, v in want.items()}
    assert {r.g: r.n for r in distinct_sets.counts(sets, ["g"]).collect()} == {
        g: len(v) for g, v in want.items()}
    union = distinct_sets.merged(sets.drop("g").withColumn("all", F.lit(1)), ["all"])
    assert distinct_sets.counts(union, ["all"]).first().n == len(set().union(*want.values()))


def test_triangles_follow_cores_not_splits(spark):
    rows = spark.range(4000).select(F.array(F.col("id") * 1.0, F.rand(3)).alias("v")).repartition(300)
    parts = moments.pair_sums(rows, "v")
    cells = {(r.i, r.j): r.total for r in parts.collect()}
    assert cells[0, -1] == sum(range(4000)) and len(cells) == 5
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" in plan
