"""Exact k-means against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark import RDD

from loopweave.llm import dimension_sharded_kmeans as ds
from loopweave.session import staged

VECTORS = "vec_id long, embedding array<double>"


def model(rows, k, rounds, dims, scale=1024.0, seed=3):
    def sound(x):
        return x is not None and len(x) == dims and all(
            c is not None and math.isfinite(c) and math.isfinite(scale * c) for c in x)

    points = [(i, [math.floor(scale * c) for c in x]) for i, x in rows if sound(x)]
    names = {i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
             for i, _ in points}
    centres = [x for _, x in sorted(points, key=lambda p: (names[p[0]], p[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in points:
            groups.setdefault(nearest(x)[1], []).append(x)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c
                   for j, c in enumerate(centres)]
    out = [(i, *nearest(x)) for i, x in points]
    most = (1 << 63) - 1
    of = [sum(min(d, most) for _, d, c in out if c == j) for j in range(len(centres))]
    return sorted(((i, c, min(d, most), min(of[c], most), min(sum(of), most), hashlib.sha256(
        ",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in out), key=repr)


def got(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia,
                    r.centroid_sha256) for r in df.collect()), key=repr)


def points(rnd, n, dims):
    return [(i, [rnd.gauss(rnd.choice([-1, 0, 2]), 0.3) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("dims", [64, 33, 3])
def test_equals_plain_integers(table, rnd, dims):
    rows = points(rnd, 250, dims) + [
        (900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [0.0] * (dims - 1)),
        (904, [float("nan")] * dims), (905, [float("inf")] * dims), (None, [0.25] * dims)]
    assert got(ds.clusters(table(VECTORS, rows, 5), rounds=4, dims=dims)) == model(
        rows, 8, 4, dims)


def test_many_packs_and_tasks(table, rnd, monkeypatch):
    monkeypatch.setattr(ds, "PACKS_A_TASK", 2)
    rows = points(rnd, 300, 20)
    assert got(ds.clusters(table(VECTORS, rows, 11), rounds=3, dims=20)) == model(rows, 8, 3, 20)


def test_ties_copies_and_empty_clusters(table):
    rows = [(i, [float(i % 2), 0.0]) for i in range(60)] + [(1, [1.0, 0.0])] * 100
    assert got(ds.clusters(table(VECTORS, rows), rounds=3, dims=2)) == model(rows, 8, 3, 2)


def test_fewer_vectors_than_clusters_and_none(table):
    rows = [(5, [0.1, -0.1]), (6, [3.0, 4.0])]
    assert got(ds.clusters(table(VECTORS, rows), rounds=2, dims=2)) == model(rows, 8, 2, 2)
    empty = ds.clusters(table(VECTORS, [(1, None)]), dims=2)
    assert empty.collect() == [] and set(empty.columns) == {
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}


def test_numbers_beyond_64_bits(table, rnd):
    rows = points(rnd, 40, 4) + [(100, [1e8, -1e8, 0.0, 1.0]), (101, [1e300, 0.0, 0.0, 0.0]),
                                 (102, [1e308, 1.0, 1.0, 1.0]), (103, [-3e12, 2.0, 1.0, 0.5])]
    assert got(ds.clusters(table(VECTORS, rows, 4), rounds=3, dims=4)) == model(rows, 8, 3, 4)


def test_extra_columns(table, rnd):
    rows = [(i, x, "c", 1) for i, x in points(rnd, 30, 2)]
    df = table("vec_id int, embedding array<float>, cluster string, distance int", rows)
    floats = [(i, [float(np.float32(c)) for c in x]) for i, x, _, _ in rows]
    assert got(ds.clusters(df, rounds=2, dims=2)) == model(floats, 8, 2, 2)


def test_a_shard_tells_its_part_of_the_distance(rnd):
    x = np.array([[rnd.randrange(-5000, 5000) for _ in range(10)] for _ in range(50)], float)
    centres = [[rnd.randrange(-5000, 5000) for _ in range(10)] for _ in range(4)]
    parts = [ds.partial_distances(x[:, c:c + 4], [z[c:c + 4] for z in centres], 1 << 27)
             for c in (0, 4, 8)]
    whole = [[int(((row - np.array(z)) ** 2).sum()) for z in centres] for row in x]
    assert sum(parts).tolist() == whole


def test_rounds_start_no_python_for_empty_partitions(table, rnd, monkeypatch):
    """RDD partitions without rows go through a Python worker each; grouped tables skip them."""
    def refuse(*_, **__):
        raise AssertionError("a round over RDDs")

    rows = points(rnd, 60, 6)
    df = table(VECTORS, rows, 3)
    for name in ("partitionBy", "mapPartitions", "mapPartitionsWithIndex"):
        monkeypatch.setattr(RDD, name, refuse)
    assert got(ds.clusters(df, rounds=2, dims=6)) == model(rows, 8, 2, 6)


def test_rounds_leave_the_blocks_where_they_are(table, rnd):
    packs = staged(ds.packed(table(VECTORS, points(rnd, 90, 6), 3), 6, 1024.0, 4, "vec_id",
                             "embedding", 10))
    shards = ds.Shards(packs, packs.count(), 6, 4)
    labels = shards.assigned([[0] * 6, [1500] * 6])
    labels.collect()
    plan = labels._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("Exchange hashpartitioning(pack") == plan.count("Exchange ")
    shards.cells.unpersist()
