"""K-means on coefficient vectors, its cost curve, single steps and outlier-aware runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.functions.matrices import on_vectors, rows_of
from loopweave.operators.aggregates import label_shares, vector_moments


def _packed(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))


def fit(df: DataFrame, vector: str, k: int = 7, iterations: int = 35,
        seed: int = 47) -> KMeansModel:
    return KMeans(featuresCol="_features", predictionCol="cluster", k=k, maxIter=iterations,
                  seed=seed).fit(_packed(df, vector))


def label(df: DataFrame, vector: str, model: KMeansModel) -> DataFrame:
    return model.transform(_packed(df, vector)).drop("_features")


def cluster_profiles(labelled: DataFrame, vector: str) -> DataFrame:
    """Size, share of all rows, mean and variance vector of every cluster in one pass."""
    shares = label_shares(labelled, "cluster")
    return shares.join(vector_moments(labelled, vector, ["cluster"]).drop("n"), "cluster")


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centres)."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _merged(partial: DataFrame, merge: Callable, tasks: int = 64) -> DataFrame:
    """Partial states of all tasks as one state, merged in two levels."""
    spark = partial.sparkSession
    wide = min(tasks, spark.sparkContext.defaultParallelism)
    once = partial.repartition(wide).mapInArrow(merge, partial.schema)
    return once.repartition(1).mapInArrow(merge, partial.schema)


_MODELS = "model int, cluster int, n long, cost double, v array<double>"


def _model_batch(states: dict[tuple[int, int], list]) -> pa.RecordBatch:
    keys = sorted(states)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([states[k][0] for k in keys], pa.int64()),
         pa.array([states[k][1] for k in keys], pa.float64()),
         pa.array([states[k][2] for k in keys], pa.list_(pa.float64()))],
        names=["model", "cluster", "n", "cost", "v"])


def _add_models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the partial states of the same cluster of the same model."""
    states: dict[tuple[int, int], list] = {}
    for batch in batches:
        for model, cluster, n, cost, v in zip(*(c.to_pylist() for c in batch.columns)):
            held = states.setdefault((model, cluster), [0, 0.0, np.zeros(len(v))])
            held[0] += n
            held[1] += cost
            held[2] = held[2] + np.array(v)
    if states:
        yield _model_batch(states)


def lloyd_steps(df: DataFrame, vector: str, models: dict[int, np.ndarray]
                ) -> dict[int, tuple[np.ndarray, float]]:
    """One Lloyd step of several models in one scan: (new centres, cost of the old ones) of each.

    A task keeps one sum for each cluster of each model. A cluster that lost all its
    rows keeps its centre. Rows without a vector take no part.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], list] = {}
        for batch in batches:
            x = rows_of(batch.column(0).drop_null())
            if not len(x):
                continue
            for model, centres in models.items():
                squared = _squared(x, centres)
                near = squared.argmin(axis=1)
                cost = squared[np.arange(len(x)), near]
                for j in np.unique(near):
                    mine = near == j
                    held = states.setdefault((model, int(j)), [0, 0.0, np.zeros(x.shape[1])])
                    held[0] += int(mine.sum())
                    held[1] += float(cost[mine].sum())
                    held[2] = held[2] + x[mine].sum(axis=0)
        if states:
            yield _model_batch(states)

    partial = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(step, _MODELS)
    out = {model: [centres.copy(), 0.0] for model, centres in models.items()}
    for row in _merged(partial, _add_models).collect():  # one row for each cluster
        held = out[row["model"]]
        held[0][row["cluster"]] = np.array(row["v"]) / row["n"]
        held[1] += row["cost"]
    return {model: (centres, cost) for model, (centres, cost) in out.items()}


def candidates(df: DataFrame, vector: str, most: int, rounds: int = 4, seed: int = 47
               ) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights): starting points for up to ``most`` clusters, and the rows near each.

    Seeding by oversampling: each round draws rows with a probability in proportion
    to their squared distance from the points so far, about twice ``most`` of them.
    Draws are hashes of the vectors, so they do not depend on partitions. Some
    ``2 * most * rounds`` points reach the driver, whatever the number of rows.
    """
    x = F.col(vector).cast("array<double>")
    rows = df.select(x.alias("v")).filter("v is not null")
    hashed = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    first = rows.orderBy(hashed, "v").limit(1).collect()
    if not first:
        raise ValueError("no vectors")
    points = np.array([r["v"] for r in first])
    for turn in range(rounds):
        distance = nearest(F.col("v"), points)["distance"]
        total = rows.agg(F.sum(distance)).first()[0]
        if not total:
            break
        draw = F.pmod(F.xxhash64("v", F.lit(seed + turn + 1)), F.lit(1 << 52)) / float(1 << 52)
        drawn = rows.filter(draw * F.lit(float(total)) < distance * F.lit(2.0 * most))
        found = drawn.distinct().orderBy("v").collect()
        if found:
            points = np.concatenate([points, np.array([r["v"] for r in found])])
    near = rows.groupBy(nearest(F.col("v"), points)["cluster"].alias("c")).count().collect()
    weights = np.zeros(len(points))
    for row in near:
        weights[row["c"]] = row["count"]
    return points, weights


def starts(points: np.ndarray, weights: np.ndarray, k: int, seed: int = 47) -> np.ndarray:
    """k of the weighted points, each drawn by its weighted distance from those before."""
    rnd = np.random.default_rng(seed + k)
    chosen = [int(rnd.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        share = weights * _squared(points, points[chosen]).min(axis=1)
        if not share.sum():  # fewer different points than clusters
            chosen.append(chosen[-1])
            continue
        chosen.append(int(rnd.choice(len(points), p=share / share.sum())))
    return points[chosen]


def all_models(df: DataFrame, vector: str, models: dict[int, np.ndarray], iterations: int = 100,
               tolerance: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """(centres, cost) of every model after at most ``iterations`` steps, all in the same scans.

    A model whose centres moved by no more than the tolerance is done; the others
    go on. A last scan gives the cost of the final centres.
    """
    going = {m: np.asarray(c, dtype="float64") for m, c in models.items()}
    done: dict[int, np.ndarray] = {}
    for _ in range(iterations):
        if not going:
            break
        for model, (new, _) in lloyd_steps(df, vector, going).items():
            shift = float(((new - going[model]) ** 2).sum(axis=1).max())
            going[model] = new
            if shift <= tolerance ** 2:
                done[model] = going.pop(model)
    final = done | going
    costs = lloyd_steps(df, vector, final)
    return {m: (final[m], costs[m][1]) for m in sorted(final)}


def cost_curve(df: DataFrame, vector: str, most: int = 15, iterations: int = 100, seed: int = 47,
               given: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(k, cost, root) for k = 1 .. ``most``, or for the ``given`` starting centres by k.

    All models are updated by the same scans, so their number follows the rounds of
    the slowest model, not the sum over all k.
    """
    if given is None:
        points, weights = candidates(df, vector, most, seed=seed)
        given = {k: starts(points, weights, k, seed) for k in range(1, most + 1)}
    fitted = all_models(df, vector, given, iterations)
    rows = [(k, cost, float(np.sqrt(max(cost, 0.0)))) for k, (_, cost) in fitted.items()]
    return df.sparkSession.createDataFrame(rows, "k int, cost double, root double")


def consecutive_change(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Absolute change against the row before; meant for short curves."""
    before = F.lag(value).over(Window.orderBy(order))
    return rows.withColumn("change", F.abs(F.col(value) - before))


def best_k(costs: DataFrame, scale: float = 1e11, below: float = 2.0,
           required: bool = True) -> DataFrame:
    """The last k before the scaled cost change first falls below the threshold.

    Costs are sums over all rows, so the changes grow with their number. If no change is
    that small, it fails, or gives a null k unless one is ``required``.
    """
    changes = consecutive_change(costs, "k", "cost")
    small = changes.filter(F.col("change") / scale < below)
    found = F.min("k") - 1
    if required:
        found = F.coalesce(found, F.raise_error(F.lit(
            "no change of the cost is below the threshold")).cast("int"))
    return small.agg(found.alias("k"))


def nearest(vector: Column, centres: np.ndarray) -> Column:
    """struct<cluster, distance>: the closest centre (lowest index on ties), squared distance."""
    c = np.asarray(centres, dtype="float64")

    def closest(x: np.ndarray) -> pa.Array:
        squared = np.stack([((x - centre) ** 2).sum(axis=1) for centre in c], axis=1)
        best = squared.argmin(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(best.astype("int32")), pa.array(squared[np.arange(len(x)), best])],
            names=["cluster", "distance"])

    return on_vectors(vector, "struct<cluster:int,distance:double>", closest)


def assign(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    return (df.withColumn("_near", nearest(F.col(vector), centres))
            .select(*df.columns, "_near.cluster", "_near.distance"))


def lloyd_step(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """(cluster, n, mean) after assigning every row to its closest centre."""
    return vector_moments(assign(df, vector, centres), vector, ["cluster"]).select(
        "cluster", "n", "mean")


def _moved(step: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """New centres (k rows reach the driver) and the squared shift.

    A cluster that lost all its rows keeps its centre.
    """
    new = centres.copy()
    for row in step.collect():
        new[row["cluster"]] = row["mean"]
    return new, float(((new - centres) ** 2).sum())


def _rounds(most: int | None):
    """Round numbers without end, or an error after ``most`` of them."""
    for turn in count():
        if turn == most:
            raise RuntimeError(f"not converged after {most} rounds")
        yield turn


def lloyd(df: DataFrame, vector: str, centres: np.ndarray, tolerance: float = 1e-4,
          most: int | None = None) -> np.ndarray:
    """Centres after iterating until the squared shift is within the tolerance.

    ``most`` limits the rounds; reaching it is an error, never a result.
    """
    centres = np.asarray(centres, dtype="float64")
    kept = df.select(vector).persist()
    try:
        for _ in _rounds(most):
            centres, shift = _moved(lloyd_step(kept, vector, centres), centres)
            if shift <= tolerance:
                return centres
    finally:
        kept.unpersist()


def first_centres(df: DataFrame, keys: list[str], vector: str, k: int, salt: str = "") -> np.ndarray:
    """k rows in key-hash order as starting centres: a repeatable random choice."""
    from loopweave.operators.sampling import hash_first

    rows = hash_first(df.select(*keys, vector), keys, k, salt).collect()
    if len(rows) < k:
        raise ValueError(f"need {k} rows for {k} centres, found {len(rows)}")
    return np.array([r[vector] for r in rows], dtype="float64")


def _order(key: dict) -> tuple:
    return tuple((v is not None, v) for v in key.values())


class _Round:
    """Sums by cluster over all rows but the farthest ones, which are held with their vectors."""

    def __init__(self, k: int, outliers: int):
        self.outliers, self.n, self.sums = outliers, [0] * k, [None] * k
        self.held: list[tuple] = []  # (-distance, order of the key, cluster, key, vector)

    def add(self, cluster: int, n: int, total: np.ndarray) -> None:
        self.n[cluster] += n
        self.sums[cluster] = total if self.sums[cluster] is None else self.sums[cluster] + total

    def hold(self, rows: list[tuple]) -> None:
        """Take rows as farthest ones; those beyond the number go to the sums."""
        self.held = sorted(self.held + rows, key=lambda r: r[:2])
        for _, _, cluster, _, v in self.held[self.outliers:]:
            self.add(cluster, 1, v)
        self.held = self.held[:self.outliers]

    def edge(self) -> float:
        """The distance that a row has to reach to be held."""
        return -self.held[-1][0] if len(self.held) == self.outliers else -1.0

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(j, n, None, None, self.sums[j]) for j, n in enumerate(self.n) if n]
        rows += [(c, 1, -d, key, v) for d, _, c, key, v in self.held]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(5)],
            schema=schema)


def trimmed_round(df: DataFrame, keys: list[str], vector: str, centres: np.ndarray, outliers: int
                  ) -> tuple[np.ndarray, np.ndarray, list[tuple[float, dict, int]]]:
    """(rows, means, farthest) of one step that sets the farthest rows aside, from one scan.

    A task keeps a sum for each cluster, and the ``outliers`` rows of its own that lie
    farthest, with their vectors and outside the sums. States merge in two levels.
    ``farthest`` are (squared distance, key, cluster), the farthest first; among equal
    distances, smaller keys are set aside first. Rows without a vector take no part.
    """
    c = np.asarray(centres, dtype="float64")
    k = len(c)
    rows = df.select(F.struct(*keys).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["key"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, schema = _Round(k, outliers), None
        for batch in batches:
            schema = schema or batch.schema.field(0).type
            batch = batch.filter(batch.column(1).is_valid())
            x = rows_of(batch.column(1))
            if not len(x):
                continue
            squared = _squared(x, c)
            near = squared.argmin(axis=1)
            distance = squared[np.arange(len(x)), near]
            far = np.flatnonzero(distance >= state.edge()) if outliers else np.zeros(0, int)
            if len(far) > outliers:  # all that tie with the last one stay in question
                edge = np.partition(distance[far], len(far) - outliers)[len(far) - outliers]
                far = far[distance[far] >= edge]
            found = batch.column(0).take(pa.array(far)).to_pylist()
            plain = np.ones(len(x), dtype=bool)
            plain[far] = False
            for j in np.unique(near[plain]):
                mine = plain & (near == j)
                state.add(int(j), int(mine.sum()), x[mine].sum(axis=0))
            state.hold([(-float(distance[i]), _order(key), int(near[i]), key, x[i])
                        for i, key in zip(far, found)])
        if schema is not None:
            yield state.batch(_round_schema(schema))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, schema = _Round(k, outliers), None
        for batch in batches:
            schema = schema or batch.schema.field(3).type
            held = []
            for cluster, n, distance, key, v in zip(*(col.to_pylist() for col in batch.columns)):
                if distance is None:
                    state.add(cluster, n, np.array(v))
                else:
                    held.append((-distance, _order(key), cluster, key, np.array(v)))
            state.hold(held)
        if schema is not None:
            yield state.batch(_round_schema(schema))

    partial = rows.mapInArrow(
        step, f"cluster int, n long, distance double, key {kind}, v array<double>")
    counts, means, farthest = np.zeros(k, dtype="int64"), c.copy(), []
    for row in _merged(partial, merge).collect():  # a row for each cluster and each one set aside
        if row["distance"] is None:
            counts[row["cluster"]] = row["n"]
            means[row["cluster"]] = np.array(row["v"]) / row["n"]
        else:
            farthest.append((row["distance"], row["key"].asDict(), row["cluster"]))
    farthest.sort(key=lambda r: (-r[0], _order(r[1])))
    return counts, means, farthest


def _round_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("distance", pa.float64()),
                      ("key", key), ("v", pa.list_(pa.float64()))])


def _aside(keys: list[str], farthest: list[tuple[float, dict, int]]) -> Column:
    """Condition for the rows that were set aside, by the last one of them."""
    if not farthest:
        return F.lit(False)
    distance, edge, _ = farthest[-1]
    beyond = F.lit(False)
    tied = F.col("distance") == F.lit(distance)
    for key in keys:
        value = F.lit(edge[key])
        before = F.col(key).isNull() if edge[key] is not None else F.lit(False)
        if edge[key] is not None:
            before = before | (F.col(key) < value)
        beyond = beyond | (tied & before)
        tied = tied & F.col(key).eqNullSafe(value)
    return (F.col("distance") > F.lit(distance)) | beyond | tied


def trimmed_step(df: DataFrame, keys: list[str], vector: str, centres: np.ndarray,
                 outliers: int) -> DataFrame:
    """(cluster, n, mean) of one step that sets the farthest rows aside."""
    counts, means, _ = trimmed_round(df, keys, vector, centres, outliers)
    rows = [(j, int(n), means[j].tolist()) for j, n in enumerate(counts) if n]
    return df.sparkSession.createDataFrame(rows, "cluster int, n long, mean array<double>")


def kmeans_with_outliers(df: DataFrame, keys: list[str], vector: str, k: int, outliers: int,
                         converge: float = 1e-4, centres: np.ndarray | None = None,
                         most: int | None = None, steps: int | None = None) -> DataFrame:
    """All rows with ``cluster``, ``distance`` and ``outlier`` after k-means has converged
    that sets the rows farthest from all centres aside in every step.

    A step is one scan of ``df``, and nothing is written; a costly input should be
    staged first. ``steps`` asks for so many steps, converged or not.
    """
    if centres is None:
        centres = first_centres(df, keys, vector, k)
    centres = np.asarray(centres, dtype="float64")
    for turn in _rounds(most):
        used = centres
        _, centres, farthest = trimmed_round(df, keys, vector, used, outliers)
        if turn + 1 == steps or (steps is None and ((centres - used) ** 2).sum() <= converge):
            break
    return assign(df, vector, used).withColumn(
        "outlier", F.coalesce(_aside(keys, farthest), F.lit(False)))


def kmeans_outliers(df: DataFrame, keys: list[str], vector: str, k: int, outliers: int,
                    converge: float = 1e-4, centres: np.ndarray | None = None,
                    most: int | None = None, steps: int | None = None) -> DataFrame:
    """Only the rows that ``kmeans_with_outliers`` sets aside."""
    rows = kmeans_with_outliers(df, keys, vector, k, outliers, converge, centres, most, steps)
    return rows.filter("outlier").drop("outlier")
