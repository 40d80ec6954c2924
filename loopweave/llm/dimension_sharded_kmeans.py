"""Lloyd's k-means in exact integers, sharded by dimension.

Vectors are packed by thousands; a pack is cut into column blocks, and each shard
owns one block of columns: its tasks hold that block of many packs, and the
slices of the centroids that belong to it. In a round, tasks compute the partial
squared distances of their blocks to their slices; a grouping by pack adds the
blocks and takes the smallest sum. The labels go back to the tasks of every shard,
which sum their own columns by cluster; from these sums the shard's slice of the
next centroids follows. Partitions without rows start no Python.

The blocks are dealt out once and kept on the executors' disks in that partitioning,
so a round moves distances and labels, never vectors. A lost executor's blocks are
computed again from the staged packs. The driver holds the centroids and one sum for each
cluster and dimension.

All arithmetic is on whole numbers: 64-bit ones where no distance can leave them,
Python's beyond. Results do not depend on partitioning.

Defined cases: a vector that is null, of another length, or holds a null or
non-finite component (also after scaling) takes no part; a null id is hashed as an
empty one; rows that repeat are vectors of their own; with fewer vectors than
clusters there are as many clusters as vectors; equal vectors may start several
clusters, of which the later stay empty and keep their place; an empty table gives
no rows; a distance or inertia beyond a long is given as the largest long.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.session import staged

PACK = 4_096  # vectors of a pack
SHARD_COLUMNS = 16
PACKS_A_TASK = 16  # so a task holds about 8 MB of blocks

_LARGEST = (1 << 63) - 1


def packed(vectors: DataFrame, dims: int, scale: float, columns: int, vec_id: str, vector: str,
           size: int = PACK) -> DataFrame:
    """(pack, ids, blocks): ``floor(scale * x)`` of up to ``size`` vectors, cut into column blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cells, held = [], [], 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(cells)
            cut = [np.ascontiguousarray(x[:, c:c + columns]).tobytes()
                   for c in range(0, dims, columns)]
            return pa.RecordBatch.from_arrays(
                [pa.array([[i for part in ids for i in part]], pa.list_(pa.int64())),
                 pa.array([cut], pa.list_(pa.binary()))], ["ids", "blocks"])

        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                lists = part.column(1)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                rows = np.flatnonzero(lengths == dims)
                first = (np.cumsum(lengths) - lengths)[rows].astype(np.int64)
                x = flat[first[:, None] + np.arange(dims)]
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * x)
                good = np.isfinite(x).all(axis=1)
                ids.append(part.column(0).take(pa.array(rows[good])).to_pylist())
                cells.append(x[good])
                held += len(cells[-1])
                if held >= size:
                    yield out()
                    ids, cells, held = [], [], 0
        if held:
            yield out()

    rows = vectors.select(F.col(vec_id).cast("long"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(pack, "ids array<long>, blocks array<binary>").withColumn(
        "pack", F.monotonically_increasing_id())


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: float, seed: int, vec_id: str,
                    vector: str) -> list[list[int]]:
    """The vectors with the ``k`` smallest hashes of their ids, as whole numbers."""
    x = F.col(vector).cast("array<double>")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("long").cast("string"),
                                                  F.lit("")))
    scaled = F.transform(x, lambda c: c * F.lit(float(scale)))
    sound = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = (vectors.filter((F.size(x) == dims) & sound)
            .select(F.sha2(name, 256).alias("hash"), scaled.alias("x")).orderBy("hash", "x")
            .limit(k).collect())
    return [[math.floor(c) for c in r["x"]] for r in rows]


def whole(x: np.ndarray, limit: int) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's where one reaches ``limit``."""
    if not x.size or float(np.abs(x).max()) < limit:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x], dtype=object)


def partial_distances(cells: np.ndarray, centres: list[list[int]], limit: int) -> np.ndarray:
    """Squared distances (rows, clusters) inside one column block."""
    x = whole(cells, limit)
    wide = x.dtype == object or any(abs(c) >= limit for centre in centres for c in centre)
    kind = object if wide else np.int64
    x = x.astype(kind)
    out = np.empty((len(x), len(centres)), dtype=kind)
    for j, centre in enumerate(centres):
        away = x - np.array(centre, dtype=kind)
        out[:, j] = (away * away).sum(axis=1)
    return out


def cluster_sums(cells: np.ndarray, labels: np.ndarray, k: int, limit: int) -> np.ndarray:
    """(k, columns + 1) sums of a block's rows by cluster, the last column their number."""
    out = np.zeros((k, cells.shape[1] + 1), dtype=object)
    x = whole(cells, limit)
    for j in np.unique(labels):
        mine = x[labels == j]
        out[j, :-1] = [int(s) for s in mine.sum(axis=0)]
        out[j, -1] = len(mine)
    return out


def _binary(arrays: list) -> pa.Array:
    """One pickled array a row: of 64-bit integers, or of Python's."""
    return pa.array([pickle.dumps(x, 5) for x in arrays], pa.binary())


def _added(table: pa.Table, column: str):
    """The sum of a group's pickled arrays."""
    return reduce(add, (pickle.loads(x.as_buffer()) for x in table.column(column)))


class Shards:
    """Column blocks, dealt to tasks by shard and pack, with one Lloyd round over them."""

    def __init__(self, packs: DataFrame, n_packs: int, dims: int, columns: int):
        self.columns, self.count, self.packs = columns, -(-dims // columns), n_packs
        # A distance of all columns stays below 2**62.
        self.limit = math.isqrt((1 << 62) // dims) // 2
        tasks = max(1, -(-n_packs // PACKS_A_TASK)) * self.count
        # Kept in this partitioning, on disk, so that no round shuffles blocks.
        self.cells = packs.select("pack", F.posexplode("blocks").alias("shard", "cells")).repartition(
            tasks, "shard", "pack").persist(StorageLevel.DISK_ONLY)
        self.cells.count()

    def _blocks(self):
        return self.cells.groupBy("shard", "pack")

    def assigned(self, centroids: list[list[int]]) -> DataFrame:
        """(pack, cluster, distance): labels and squared distances for the given centroids."""
        columns, limit = self.columns, self.limit
        slices = [[c[s * columns:(s + 1) * columns] for c in centroids] for s in range(self.count)]

        def partials(table: pa.Table) -> pa.Table:
            out = []
            for shard, cells in zip(table.column("shard").to_pylist(), table.column("cells")):
                x = np.frombuffer(cells.as_buffer()).reshape(-1, len(slices[shard][0]))
                out.append(partial_distances(x, slices[shard], limit))
            return pa.table({"pack": table.column("pack"), "part": _binary(out)})

        def nearest(table: pa.Table) -> pa.Table:
            total = _added(table, "part")
            labels = np.argmin(total, axis=1)  # the first of equal ones
            least = np.minimum(total[np.arange(len(total)), labels], _LARGEST).astype(np.int64)
            return pa.table({"pack": table.column("pack")[:1],
                             "cluster": pa.array([labels.astype(np.int32)], pa.list_(pa.int32())),
                             "distance": pa.array([least], pa.list_(pa.int64()))})

        return (self._blocks().applyInArrow(partials, "pack long, part binary").groupBy("pack")
                .applyInArrow(nearest, "pack long, cluster array<int>, distance array<long>"))

    def next_centroids(self, centroids: list[list[int]]) -> list[list[int]]:
        """Each shard's slices from the floored means of its own columns; empty clusters stay."""
        columns, limit, count, k = self.columns, self.limit, self.count, len(centroids)
        widths = [len(centroids[0][s * columns:(s + 1) * columns]) for s in range(count)]
        told = self.assigned(centroids).select("pack", "cluster", F.explode(
            F.sequence(F.lit(0), F.lit(count - 1))).alias("shard"))
        slots = math.isqrt(self.packs) + 1
        kind = "shard int, slot long, sums binary"

        def sums(blocks: pa.Table, labels: pa.Table) -> pa.Table:
            shards, packs = blocks.column("shard").to_pylist(), blocks.column("pack").to_pylist()
            of = labels.column("cluster")[0].values.to_numpy()
            out = [cluster_sums(np.frombuffer(cells.as_buffer()).reshape(-1, widths[shard]), of, k,
                                limit) for shard, cells in zip(shards, blocks.column("cells"))]
            return pa.table({"shard": pa.array(shards, pa.int32()), "slot": pa.array(
                [p % slots for p in packs], pa.int64()), "sums": _binary(out)})

        def added(table: pa.Table) -> pa.Table:
            return pa.table({"shard": table.column("shard")[:1], "slot": table.column("slot")[:1],
                             "sums": _binary([_added(table, "sums")])})

        # In two levels, so that no task adds up all packs of a shard.
        each = self._blocks().cogroup(told.groupBy("shard", "pack")).applyInArrow(sums, kind)
        rows = (each.groupBy("shard", "slot").applyInArrow(added, kind)
                .groupBy("shard").applyInArrow(added, kind).collect())
        slices = {r["shard"]: pickle.loads(r["sums"]) for r in rows}
        return [[int(total) // int(slices[s][j, -1]) if slices[s][j, -1] else centroids[j][
                    s * columns + i]
                 for s in range(count) for i, total in enumerate(slices[s][j, :-1])]
                for j in range(k)]


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0,
          seed: int = 3, columns: int = SHARD_COLUMNS, vec_id: str = "vec_id",
          vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector that takes part, the final centroids)."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, dims, scale, seed, vec_id, vector)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    packs = staged(packed(vectors, dims, scale, columns, vec_id, vector), "packs")
    shards = Shards(packs, packs.count(), dims, columns)
    for _ in range(rounds):
        centroids = shards.next_centroids(centroids)
    found = staged(shards.assigned(centroids), "labels")
    shards.cells.unpersist()
    each = packs.select("pack", "ids").join(found, "pack").select(F.explode(F.arrays_zip(
        F.col("ids").alias("vec_id"), "cluster", "distance")).alias("v"))
    return each.select("v.*"), centroids


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64,
             scale: float = 1024.0, seed: int = 3, vec_id: str = "vec_id",
             vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    assigned, centroids = lloyd(vectors, k, rounds, dims, scale, seed, vec_id=vec_id,
                                vector=vector)
    members = staged(assigned, "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r[0]: int(r[1]) for r in members.groupBy("cluster").agg(total).collect()}

    def long(value):
        return F.lit(min(value, _LARGEST)).cast("long")

    def by_cluster(values, kind):
        return (F.element_at(F.array(*values), F.col("cluster") + 1) if values
                else F.lit(None)).cast(kind)

    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return members.select(
        "*", by_cluster([long(sums.get(j, 0)) for j in range(len(centroids))], "long").alias(
            "cluster_inertia"),
        long(sum(sums.values())).alias("inertia"),
        by_cluster([F.lit(s) for s in shas], "string").alias("centroid_sha256"))
