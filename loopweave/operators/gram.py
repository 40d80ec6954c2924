"""Elastic-net regressions of all groups from one scan, by mergeable Gram matrices.

A task keeps, for each group and side (training or held out), the number of rows,
the means, and the products of deviations from the means, of label and features
together. Two such states merge exactly into one (their means differ, so the product
of the differences is added); deviations keep the digits that raw products lose.
States of a group merge by key, in two levels for as long as many tasks hold it, and
each group is then solved on its own matrix, in parallel. Coordinate descent needs
nothing but that matrix, and so does R² on the held-out rows.

The penalty is that of Spark's linear regression with standardised features:
``1/2n |y - Xb|² + reg (a sum|b_j s_j| + (1 - a) / (2 s_y) sum (b_j s_j)²)`` with the
population deviations s.

Defined cases: a row with a missing label or feature is left out; a null group value
is a group; a constant feature has weight 0; a group without training rows has null
weights, one without held-out rows, or with one label only, a null R².
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.functions.matrices import rows_of
from loopweave.operators.sampling import below

HELD = 2_000_000  # numbers of states that a task holds before it passes them on
LANES = 32  # tasks that merge the states of one group, before the last one
_STATE = "n long, mean array<double>, products array<double>"


def merged(a: tuple, b: tuple) -> tuple:
    """Two states (n, mean, products of deviations) as one."""
    n = a[0] + b[0]
    away = b[1] - a[1]
    return (n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n))


def _batch(states: dict[tuple, tuple], names: list[str], kinds: list[pa.DataType]
           ) -> pa.RecordBatch:
    keys = list(states)
    columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
    columns.append(pa.array([states[k][0] for k in keys], pa.int64()))
    for part in (1, 2):
        columns.append(pa.array([states[k][part].ravel() for k in keys], pa.list_(pa.float64())))
    return pa.RecordBatch.from_arrays(columns, [*names, "n", "mean", "products"])


def gram(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """(groups, n, mean, products) over the rows that have all columns: one row for each group."""
    width = len(columns)
    rows = df.select(*groups, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias(
        "_v")).filter(~F.exists("_v", lambda v: v.isNull() | F.isnan(v)))
    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    schema = f"{keyed}, {_STATE}" if groups else _STATE
    most = max(1, HELD // (width * width))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [c.type for c in batch.columns[:-1]]
            x = rows_of(batch.column(len(groups)))
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]))) or [()] * len(x)
            number: dict[tuple, int] = {}
            of = np.array([number.setdefault(k, len(number)) for k in keys])
            for key, j in number.items():
                mine = x[of == j]
                mean = mine.mean(axis=0)
                away = mine - mean
                state = (len(mine), mean, away.T @ away)
                states[key] = merged(states[key], state) if key in states else state
            if len(states) > most:
                yield _batch(states, groups, kinds)
                states = {}
        if states:
            yield _batch(states, groups, kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [c.type for c in batch.columns[:-3]]
            for *key, n, mean, products in zip(*(c.to_pylist() for c in batch.columns)):
                state = (n, np.array(mean), np.array(products).reshape(width, width))
                key = tuple(key)
                states[key] = merged(states[key], state) if key in states else state
                if len(states) > most:
                    yield _batch(states, groups, kinds)
                    states = {}
        if states:
            yield _batch(states, groups, kinds)

    partial = rows.mapInArrow(collect, schema)
    lane = F.pmod(F.spark_partition_id(), F.lit(LANES))
    spread = partial.withColumn("_lane", lane)
    once = spread.repartition(*groups, "_lane").drop("_lane").mapInArrow(add, schema)
    # At most a state for each lane (more if a task passed some on early): one last merge by key.
    return once.groupBy(*groups).agg(F.collect_list(F.struct("n", "mean", "products")).alias(
        "_parts")).mapInArrow(_joined(groups, width), schema)


def _joined(groups: list[str], width: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = {}
            kinds = [c.type for c in batch.columns[:-1]]
            for *key, parts in zip(*(c.to_pylist() for c in batch.columns)):
                total = None
                for p in parts:
                    state = (p["n"], np.array(p["mean"]),
                             np.array(p["products"]).reshape(width, width))
                    total = state if total is None else merged(total, state)
                if total is not None:
                    states[tuple(key)] = total
            if states:
                yield _batch(states, groups, kinds)

    return join


def solve(n: int, products: np.ndarray, reg: float, mix: float, tolerance: float = 1e-12,
          rounds: int = 100_000) -> np.ndarray:
    """Weights of the features from the products of deviations; entry 0 is the label."""
    xx, xy, yy = products[1:, 1:], products[1:, 0], products[0, 0]
    usable = np.diag(xx) > 1e-12 * max(1e-300, float(np.diag(xx).max(initial=0.0)))
    out = np.zeros(len(xy))
    if n < 2 or not usable.any() or yy <= 0:
        return out
    a, b = xx[np.ix_(usable, usable)] / n, xy[usable] / n
    if reg == 0:
        out[usable] = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        return out
    scale = np.sqrt(np.diag(a))
    a, b = a / np.outer(scale, scale), b / scale
    first = reg * mix
    size = np.sqrt(yy / n)
    second = reg * (1 - mix) / size
    w = np.zeros(len(b))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            rest = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - first, 0.0) / (a[j, j] + second)
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= tolerance * size:
            out[usable] = w / scale
            return out
    raise RuntimeError(f"not converged after {rounds} rounds")


def elastic_nets(df: DataFrame, groups: list[str], label: str, features: list[str],
                 keys: list[str], train: float | None = 0.7, reg_param: float = 0.0,
                 elastic_net: float = 0.5, salt: str = "47") -> DataFrame:
    """(groups, feature, weight, intercept, r2, n): one regression for each group, one scan for all.

    Rows go to the training side by key hash; ``train=None`` fits and scores all.
    """
    side = F.lit(True) if train is None else below(train, *keys, salt=salt)
    columns = [label, *features]
    states = gram(df.withColumn("_train", side), [*groups, "_train"], columns)
    both = states.groupBy(*groups).agg(*[F.max(F.when(F.col("_train") == is_train, F.struct(
        "n", "mean", "products"))).alias(name) for name, is_train in (("_fit", True),
                                                                      ("_score", False))])
    if train is None:
        both = both.withColumn("_score", F.col("_fit"))
    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                      for f in both.select(*groups).schema) if groups else ""
    schema = ", ".join(s for s in (keyed, "feature string, weight double, intercept double,"
                                   " r2 double, n long") if s)
    width = len(columns)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [c.type for c in batch.columns[:-2]]
            rows = []
            for *key, on, of in zip(*(c.to_pylist() for c in batch.columns)):
                weights, intercept, r2 = [None] * len(features), None, None
                if on:
                    w = solve(on["n"], np.array(on["products"]).reshape(width, width), reg_param,
                              elastic_net)
                    mean = np.array(on["mean"])
                    weights, intercept = w.tolist(), float(mean[0] - mean[1:] @ w)
                    r2 = _r2(of, w, intercept, width)
                rows += [(*key, f, weight, intercept, r2, on["n"] if on else 0)
                         for f, weight in zip(features, weights)]
            kinds = [*kinds, pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                [*groups, "feature", "weight", "intercept", "r2", "n"])

    return both.select(*groups, "_fit", "_score").mapInArrow(fit, schema)


def _r2(of: dict | None, w: np.ndarray, intercept: float, width: int) -> float | None:
    """Share of the label's squared deviations that the weights explain."""
    if not of:
        return None
    products = np.array(of["products"]).reshape(width, width)
    if products[0, 0] <= 0:
        return None
    mean = np.array(of["mean"])
    off = mean[0] - mean[1:] @ w - intercept
    left = (products[0, 0] - 2 * (w @ products[1:, 0]) + w @ products[1:, 1:] @ w
            + of["n"] * off * off)
    return float(1 - left / products[0, 0])
