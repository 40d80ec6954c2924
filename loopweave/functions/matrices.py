"""Arrow batches of vectors as numpy matrices, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column without null rows as a matrix; null cells become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    if len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def as_lists(x: np.ndarray) -> pa.Array:
    """Matrix rows as a list column."""
    edges = np.arange(len(x) + 1, dtype="int32") * (x.shape[1] if len(x) else 0)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(x).ravel()))


def on_vectors(vector: Column, kind: str, compute: Callable[[np.ndarray], pa.Array]) -> Column:
    """Apply ``compute`` (matrix of a batch to one value per row); null vectors give null."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            present = batch.drop_null()
            if not len(present):
                yield pa.nulls(len(batch), _arrow_type(kind))
                continue
            out = compute(rows_of(present))
            if batch.null_count:
                seen = np.asarray(batch.is_valid())
                places = np.cumsum(seen) - 1
                out = out.take(pa.array(places, mask=~seen))
            yield out

    return run(vector.cast("array<double>"))


def _arrow_type(kind: str) -> pa.DataType:
    return {"double": pa.float64(), "array<double>": pa.list_(pa.float64()),
            "struct<cluster:int,distance:double>": pa.struct(
                [("cluster", pa.int32()), ("distance", pa.float64())])}[kind]
