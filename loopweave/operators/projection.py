"""Principal components: fit, project, reconstruct, compare."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.functions import vectors
from loopweave.functions.matrices import as_lists, on_vectors
from loopweave.operators import aggregates, moments


@dataclass(frozen=True)
class Basis:
    """Mean (n), components (k x n) and the share of all variance of each component."""

    mean: np.ndarray
    components: np.ndarray
    ratios: np.ndarray

    @property
    def k(self) -> int:
        return len(self.components)

    def first(self, k: int) -> Basis:
        return Basis(self.mean, self.components[:k], self.ratios[:k])

    def to_df(self, spark: SparkSession) -> DataFrame:
        row = (self.mean.tolist(), self.components.tolist(), self.ratios.tolist())
        return spark.createDataFrame(
            [row], "mean array<double>, components array<array<double>>, ratios array<double>")

    @staticmethod
    def from_df(df: DataFrame) -> Basis:
        row = df.first()
        return Basis(np.array(row["mean"]), np.array(row["components"]), np.array(row["ratios"]))


def fixed_signs(components: np.ndarray) -> np.ndarray:
    """Turn every component so that its largest entry is positive."""
    largest = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(len(components)), largest])
    return components * np.where(signs == 0, 1, signs)[:, None]


def fit(df: DataFrame, vector: str, k: int) -> Basis:
    """Components of the sample covariance. Only n x n numbers reach the driver."""
    mean = moments.mean_vector(df, vector)
    if not 1 <= k <= len(mean):
        raise ValueError(f"k must be between 1 and {len(mean)}")
    packed = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(packed)
    components = fixed_signs(model.pc.toArray().T)
    return Basis(mean, components, model.explainedVariance.toArray())


def fit_parts(df: DataFrame, vector: str, parts: dict[str, Column], k: int) -> dict[str, Basis]:
    """One basis per named condition, such as weekday and weekend."""
    return {name: fit(df.filter(condition), vector, k) for name, condition in parts.items()}


def fit_measures(df: DataFrame, measures: list[str], keys: list[str], k: int,
                 samples: int = 10) -> dict[str, dict]:
    """Per measure: basis, standard deviation vector and a few repeatable sample rows."""
    from loopweave.operators.sampling import hash_first

    return {m: {
        "basis": fit(df, m, k),
        "std": aggregates.vector_moments(df, m).select("std"),
        "samples": hash_first(df.select(*keys, m), keys, samples),
    } for m in measures}


def project(vector: Column, basis: Basis, centre: bool = True) -> Column:
    """Coefficients of a vector; the mean is subtracted first unless told otherwise."""
    axes = basis.components.T
    mean = basis.mean if centre else np.zeros_like(basis.mean)
    return on_vectors(vector, "array<double>", lambda x: as_lists((x - mean) @ axes))


def reconstruct(coefficients: Column, basis: Basis, centre: bool = True) -> Column:
    axes = basis.components
    mean = basis.mean if centre else np.zeros_like(basis.mean)
    return on_vectors(coefficients, "array<double>", lambda c: as_lists(c @ axes + mean))


def mean_of_reconstruction(coefficients: Column, basis: Basis) -> Column:
    """Average of the reconstructed vector, without building it.

    The average is linear, so it is a dot product with the averaged components.
    """
    weights = basis.components.mean(axis=1)
    total = F.lit(float(basis.mean.mean()))
    for i, w in enumerate(weights):
        total = total + coefficients[i] * F.lit(float(w))
    return total


def transform(df: DataFrame, vector: str, basis: Basis, keys: list[str],
              centre: bool = True) -> DataFrame:
    """Keys and ``V0 .. V{k-1}``."""
    rows = df.select(*keys, project(F.col(vector), basis, centre).alias("_c"))
    return rows.select(*keys, *[F.col("_c")[i].alias(f"V{i}") for i in range(basis.k)])


def transform_parts(df: DataFrame, vector: str, parts: dict[str, Column],
                    bases: dict[str, Basis], keys: list[str],
                    basis: str | None = None) -> DataFrame:
    """Project each part on its own basis, or all parts on the named one, in one scan.

    A row belongs to the first part whose condition holds; rows of no part are left out.
    """
    part, free = F.lit(None).cast("string"), F.lit(True)
    coefficients = []
    for name, condition in parts.items():
        mine = free & F.coalesce(condition, F.lit(False))
        part = F.when(mine, F.lit(name)).otherwise(part)
        coefficients.append(project(F.when(mine, F.col(vector)), bases[basis or name]))
        free = free & ~F.coalesce(condition, F.lit(False))
    k = max(b.k for b in bases.values())
    rows = df.select(*keys, F.coalesce(*coefficients).alias("_c"), part.alias("part"))
    return rows.filter(F.col("part").isNotNull()).select(
        *keys, *[F.get("_c", F.lit(i)).alias(f"V{i}") for i in range(k)], "part")


def with_errors(df: DataFrame, original: str, rebuilt: str) -> DataFrame:
    """Add mse, rmse and rmse over the range of the original."""
    a, b = F.col(original).cast("array<double>"), F.col(rebuilt)
    spread = F.array_max(a) - F.array_min(a)
    return (df.withColumn("mse", vectors.mse(a, b))
            .withColumn("rmse", F.sqrt("mse"))
            .withColumn("nrmse", F.try_divide(F.col("rmse"), spread)))


def truncation_errors(vector: Column, basis: Basis, ks: list[int]) -> Column:
    """Mean squared error of the reconstruction for several k in one pass.

    NaN cells become 0 after centring, that is, the mean.
    """
    mean, axes = basis.mean, basis.components

    def errors(x: np.ndarray) -> pa.Array:
        x = np.nan_to_num(x - mean)
        c = x @ axes.T
        return as_lists(np.stack([((x - c[:, :k] @ axes[:k]) ** 2).mean(axis=1) for k in ks],
                                 axis=1))

    return on_vectors(vector, "array<double>", errors)


def compare_truncations(df: DataFrame, vector: str, basis: Basis, keys: list[str],
                        ks: list[int]) -> DataFrame:
    """(keys, k, mse)."""
    rows = df.select(*keys, truncation_errors(F.col(vector), basis, ks).alias("_e"))
    labelled = F.arrays_zip(F.array(*[F.lit(k) for k in ks]).alias("k"), F.col("_e").alias("mse"))
    return rows.select(*keys, F.explode(labelled).alias("_r")).select(*keys, "_r.k", "_r.mse")


def explain_others(df: DataFrame, vector: str, group: str, chosen, k: int) -> DataFrame:
    """Fit on one group, rebuild all rows uncentred, average error per group."""
    basis = fit(df.filter(F.col(group) == F.lit(chosen)), vector, k)
    coefficients = project(F.col(vector), basis, centre=False)
    rebuilt = df.select(group, vector, coefficients.alias("_c")).withColumn(
        "_r", reconstruct(F.col("_c"), basis, centre=False))
    return (with_errors(rebuilt, vector, "_r").groupBy(group)
            .agg(F.count("*").alias("n"), F.avg("mse").alias("mse"), F.avg("nrmse").alias("nrmse"))
            .withColumn("fitted", F.col(group) == F.lit(chosen)))


def group_average_error(projected: DataFrame, group: str, coefficients: str, vector: str,
                        basis: Basis, sample: DataFrame) -> DataFrame:
    """Rebuild the average coefficients of each group and compare with sample rows.

    ``sample`` holds the group and original vectors of a few rows per group.
    """
    means = aggregates.vector_moments(projected, coefficients, [group]).select(
        group, F.col("mean").alias("_c"))
    rebuilt = means.select(group, reconstruct(F.col("_c"), basis).alias("_r"))
    return with_errors(sample.join(rebuilt, group), vector, "_r").drop("_r")


def eigen_from_covariance(cells: DataFrame, spark: SparkSession) -> DataFrame:
    """(component, eigenvalue, vector), by falling absolute eigenvalue.

    ``cells`` is an upper-triangle covariance, such as the NaN-aware one.
    """
    values, columns = np.linalg.eigh(moments.matrix(cells))
    order = np.argsort(-np.abs(values), kind="stable")
    axes = fixed_signs(columns[:, order].T)
    rows = [(i, float(values[o]), axes[i].tolist()) for i, o in enumerate(order)]
    return spark.createDataFrame(rows, "component int, eigenvalue double, vector array<double>")


def fit_from_covariance(df: DataFrame, vector: str, k: int) -> Basis:
    """The same basis from our own covariance: a second implementation to check against."""
    mean = moments.mean_vector(df, vector)
    covariance = moments.matrix(moments.sample_covariance(df, vector, mean))
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:k]
    return Basis(mean, fixed_signs(columns[:, order].T), values[order] / values.sum())
