"""First and second moments of wide vectors, with mergeable partial sums per task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.functions.matrices import rows_of

PARTIALS_PER_CORE = 2

_PARTIAL = "i int, sums array<double>, counts array<double>"


def _partial_sums(batches: Iterator[pa.RecordBatch],
                  shift: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Sums and counts of cells and cell products over all batches of a task.

    Row i carries entry i of the vector sum, then the products with i, i+1, ...
    """
    state = None
    for batch in batches:
        x = rows_of(batch.column(0).drop_null())
        if not len(x):
            continue
        if shift is not None:
            x = x - shift
        seen = ~np.isnan(x)
        x = np.where(seen, x, 0.0)
        seen = seen.astype("float64")
        part = [x.sum(0), seen.sum(0), x.T @ x, seen.T @ seen]
        state = part if state is None else [a + b for a, b in zip(state, part)]
    if state is None:
        return
    total, count, products, pairs = state
    n = len(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int32()),
         pa.array([np.concatenate(([total[i]], products[i, i:])) for i in range(n)],
                  pa.list_(pa.float64())),
         pa.array([np.concatenate(([count[i]], pairs[i, i:])) for i in range(n)],
                  pa.list_(pa.float64()))],
        names=["i", "sums", "counts"])


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partial rows of the same i; holds one row per i at a time."""
    totals: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i, sums, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            part = [np.asarray(v.values, dtype="float64") for v in (sums, counts)]
            totals[i] = [a + b for a, b in zip(totals[i], part)] if i in totals else part
    if totals:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()),
             *[pa.array([v[k] for v in totals.values()], pa.list_(pa.float64()))
               for k in range(2)]], names=["i", "sums", "counts"])


def pair_sums(df: DataFrame, vector: str, shift: np.ndarray | None = None) -> DataFrame:
    """(i, j, total, n): sums of x_i * x_j for j >= i, and of x_i alone under j = -1.

    ``shift`` is subtracted from every vector first. Each task reduces its rows
    to one triangular matrix; only the rows of those are shuffled, as arrays,
    and added up by row number before they become cells.

    There are as many triangles as the cluster runs tasks at a time, not one for each
    split of the input: splits are read one after another into the same triangle.
    """
    together = PARTIALS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    triangles = df.select(F.col(vector).cast("array<double>").alias("v")).coalesce(
        together).mapInArrow(partial(_partial_sums, shift=shift), _PARTIAL)
    added = triangles.repartition("i").mapInArrow(_added_up, _PARTIAL)
    cells = added.select("i", F.posexplode(F.arrays_zip("sums", "counts")).alias("p", "c"))
    return cells.select("i", F.when(F.col("p") == 0, -1).otherwise(F.col("i") + F.col("p") - 1)
                        .alias("j"), F.col("c.sums").alias("total"),
                        F.col("c.counts").cast("long").alias("n"))


def nan_mean(df: DataFrame, vector: str) -> DataFrame:
    """(i, n, mean) over the cells that are not NaN; 0 when there are none."""
    return _means(pair_sums(df, vector))


def _means(sums: DataFrame) -> DataFrame:
    return sums.filter(F.col("j") == -1).select(
        "i", "n", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("mean"))


def nan_covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j >= i, n, covariance) with E[uv] - E[u]E[v]; NaN cells are left out of each mean."""
    sums = pair_sums(df, vector)
    means = _means(sums)
    both = F.coalesce(F.try_divide("total", "n"), F.lit(0.0))
    return (sums.filter(F.col("j") >= 0)
            .join(means.select("i", F.col("mean").alias("_mi")), "i")
            .join(means.select(F.col("i").alias("j"), F.col("mean").alias("_mj")), "j")
            .select("i", "j", "n", (both - F.col("_mi") * F.col("_mj")).alias("covariance")))


def sample_covariance(df: DataFrame, vector: str, mean: np.ndarray | None = None) -> DataFrame:
    """(i, j >= i, covariance) with n - 1, of vectors without NaN.

    The mean (given, or found in a pass of its own) is subtracted before the
    products are summed, which keeps the digits that E[uv] - E[u]E[v] would lose
    on large values.
    """
    mean = mean_vector(df, vector) if mean is None else mean
    return (pair_sums(df, vector, mean).filter(F.col("j") >= 0)
            .select("i", "j", (F.col("total") / (F.col("n") - 1)).alias("covariance")))


def mean_vector(df: DataFrame, vector: str) -> np.ndarray:
    """The mean as a local array: one number per vector position."""
    from loopweave.operators.aggregates import vector_moments

    row = vector_moments(df, vector).select("mean").first()
    if row is None:
        raise ValueError("no vectors")
    return np.array(row["mean"])


def matrix(cells: DataFrame, value: str = "covariance") -> np.ndarray:
    """Upper-triangle cells as a symmetric local matrix (vector width squared, no data rows)."""
    rows = cells.select("i", "j", value).toArrow()
    i, j, v = (rows.column(k).to_numpy() for k in range(3))
    out = np.zeros((int(j.max()) + 1,) * 2)
    out[i, j] = v
    out[j, i] = v
    return out
