"""Outlier detectors with a common shape: fit on rows, detect with a threshold."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.functions.matrices import on_vectors
from loopweave.operators import clustering, moments


class Detector(Protocol):
    def fit(self, df: DataFrame) -> Detector: ...

    def detect(self, df: DataFrame, threshold: float) -> DataFrame: ...


def quadratic_distance(vector: Column, centre: np.ndarray, inverse: np.ndarray) -> Column:
    def distance(x: np.ndarray) -> pa.Array:
        away = x - centre
        squared = ((away @ inverse) * away).sum(axis=1)
        return pa.array(np.sqrt(np.maximum(squared, 0.0)))

    return on_vectors(vector, "double", distance)


class Mahalanobis:
    """Distance from the mean in units of the sample covariance.

    Rows beyond mean + threshold * spread of all distances are outliers; the
    spread is the standard deviation, or the variance as an option.
    """

    def __init__(self, vector: str, spread: str = "std"):
        if spread not in ("std", "variance"):
            raise ValueError("spread is 'std' or 'variance'")
        self.vector, self.spread = vector, spread
        self.centre: np.ndarray | None = None
        self.inverse: np.ndarray | None = None

    def fit(self, df: DataFrame) -> Mahalanobis:
        centre = moments.mean_vector(df, self.vector)
        covariance = moments.matrix(moments.sample_covariance(df, self.vector, centre))
        if not np.all(np.isfinite(covariance)) or np.linalg.matrix_rank(covariance) < len(covariance):
            raise ValueError("the covariance is singular: a column is constant or dependent")
        self.centre = centre
        self.inverse = np.linalg.inv(covariance)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        if self.centre is None:
            raise ValueError("fit first")
        return df.withColumn("distance",
                             quadratic_distance(F.col(self.vector), self.centre, self.inverse))

    def detect(self, df: DataFrame, threshold: float = 1.0) -> DataFrame:
        scored = self.score(df)
        spread = {"std": F.stddev_pop, "variance": F.var_pop}[self.spread]("distance")
        limit = scored.agg(F.avg("distance") + spread * F.lit(threshold)).scalar()
        return scored.filter(F.col("distance") > limit)


class TrimmedKMeans:
    """K-means that sets a number of farthest rows aside; those are the outliers."""

    def __init__(self, keys: list[str], vector: str, k: int, outliers: int):
        self.keys, self.vector, self.k, self.outliers = keys, vector, k, outliers
        self.centres: np.ndarray | None = None

    def fit(self, df: DataFrame) -> TrimmedKMeans:
        self.centres = clustering.first_centres(df, self.keys, self.vector, self.k)
        return self

    def detect(self, df: DataFrame, threshold: float = 1e-4) -> DataFrame:
        """``threshold`` is the squared centre shift at which iterations stop."""
        if self.centres is None:
            raise ValueError("fit first")
        return clustering.kmeans_outliers(df, self.keys, self.vector, self.k, self.outliers,
                                          threshold, self.centres)
