"""Exact top-k by inner product, with block-at-a-time pruning.

Vectors are kept in shards (one row each): a forward index of blocks of
neighbouring vectors, and for every block the largest and smallest value of each
dimension (the dimensions are the terms). For a query, the summed maxima of its
terms bound every score in a block. Each query visits the blocks of a shard in
the order of their bounds, scores them through the forward index, and stops at
the first block whose bound lies below its k-th best score so far. A bound equal
to it is still scored, since a tie may go to a smaller id. So the result is exact.

Queries form blocks as well; each block of queries meets each shard once, through
an equi-join on shard slots, so neither side is broadcast or gathered.

Defined cases: a vector that is null, empty, or holds a null or non-finite
component takes no part, nor does one whose scaled component is beyond a double, nor
a row without an id; components of any other size count exactly, scores beyond
64 bits as the nearest of ``-MOST`` and ``MOST``; vectors meet only vectors of the
same length; a row's own id is never its neighbour; query rows that repeat
with the same vector are one query, candidates that repeat are rows of their own;
with fewer candidates than k, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopweave.session import staged

SHARD = 16_384  # vectors of a shard
BLOCK = 256  # vectors of a block
QUERIES = 512  # queries of a block of queries
EXACT = float(1 << 53)
LONG = float(1 << 62)
MOST = (1 << 63) - 1


def _neighbours(x: np.ndarray, block: int) -> np.ndarray:
    """An order in which runs of ``block`` rows are alike: halve at the widest dimension."""
    parts, out = [np.arange(len(x))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        widest = int(np.argmax(x[rows].var(axis=0)))
        half = -(-len(rows) // (2 * block)) * block  # whole blocks on the left
        split = np.argsort(x[rows, widest], kind="stable")
        parts.append(rows[split[half:]])
        parts.append(rows[split[:half]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _packed(df: DataFrame, vec_id: str, vector: str, scale: float, size: int) -> DataFrame:
    """(dims, wide, part, ids, cells): up to ``size`` vectors in a row, scaled and floored.

    Cells are 32-bit integers; vectors that need more lie in rows of their own (``wide``),
    as doubles, which hold every floored double exactly.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def row(kind: tuple[int, bool]) -> pa.RecordBatch:
            ids = np.concatenate([a for a, _ in waiting[kind]])
            cells = np.concatenate([b for _, b in waiting[kind]])
            waiting[kind] = [(ids[size:], cells[size:])]
            return pa.RecordBatch.from_arrays(
                [pa.array([kind[0]], pa.int32()), pa.array([kind[1]], pa.bool_()),
                 pa.array([ids[:size].tobytes()], pa.binary()),
                 pa.array([cells[:size].tobytes()], pa.binary())],
                names=["dims", "wide", "ids", "cells"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == dims)
                x = np.floor(scale * flat[starts[rows][:, None] + np.arange(dims)])
                good = np.isfinite(x).all(axis=1)
                large = (np.abs(x) >= 2.0 ** 31).any(axis=1)
                for wide, here in ((False, good & ~large), (True, good & large)):
                    kind = (int(dims), wide)
                    waiting.setdefault(kind, []).append(
                        (ids[rows[here]].astype(np.int64), x[here].astype(_cells(wide))))
                    while sum(len(a) for a, _ in waiting[kind]) >= size:
                        yield row(kind)
        for kind in waiting:
            if sum(len(a) for a, _ in waiting[kind]):
                yield row(kind)

    rows = df.select(F.col(vec_id).cast("long").alias("id"),
                     F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter("id is not null and x is not null")
    return rows.mapInArrow(pack, "dims int, wide boolean, ids binary, cells binary").withColumn(
        "part", F.monotonically_increasing_id())


def _cells(wide: bool) -> type:
    return np.float64 if wide else np.int32


def _largest(q: np.ndarray, x: np.ndarray) -> float:
    """No score, nor the sum of any of its products, is larger than this."""
    return float(np.abs(q.astype(np.float64)).max(initial=0)) * float(
        np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where that is exact, else in integers."""
    if _largest(q, x) < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


NONE = np.iinfo(np.int64).min


def search_shard(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int,
                 block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of each query's k best rows of a shard, and how many blocks were scored.

    Missing places have the score NONE.
    """
    order = _neighbours(x, block)
    edges = np.arange(0, len(x), block)
    blocks = [order[e:e + block] for e in edges]
    top = np.stack([x[b].max(axis=0) for b in blocks])
    low = np.stack([x[b].min(axis=0) for b in blocks])
    bounds = _scores(np.maximum(q, 0), top) + _scores(np.minimum(q, 0), low)
    visits = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(q), k), NONE)
    who = np.zeros((len(q), k), dtype=np.int64)
    active, scored = np.arange(len(q)), 0
    for turn in range(len(blocks)):
        mine = visits[active, turn]
        going = bounds[active, mine] >= best[active, -1]
        active, mine = active[going], mine[going]
        if not len(active):
            break
        for b in np.unique(mine):
            rows = active[mine == b]
            members = blocks[b]
            scores = _scores(q[rows], x[members])
            scores[q_ids[rows][:, None] == ids[members][None, :]] = NONE
            all_scores = np.concatenate([best[rows], scores], axis=1)
            all_ids = np.concatenate(
                [who[rows], np.broadcast_to(ids[members], scores.shape)], axis=1)
            first = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~ turns the order round
            best[rows] = np.take_along_axis(all_scores, first, axis=1)
            who[rows] = np.take_along_axis(all_ids, first, axis=1)
            scored += len(rows)
    return best, who, scored


def search_large(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) as ``search_shard`` gives them, where products need more than 64 bits.

    Every row is scored in Python's integers, a query at a time.
    """
    best, who = np.full((len(q), k), NONE), np.zeros((len(q), k), dtype=np.int64)
    whole = np.vectorize(int, otypes=[object])
    columns = whole(x).T
    for i, vector in enumerate(whole(q)):
        scores = np.array([max(-MOST, min(MOST, s)) for s in vector @ columns], dtype=np.int64)
        others = np.flatnonzero(ids != q_ids[i])
        first = others[np.lexsort((ids[others], ~scores[others]))[:k]]
        best[i, :len(first)], who[i, :len(first)] = scores[first], ids[first]
    return best, who


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id",
          vector: str = "embedding", scale: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query.

    Components count as ``floor(scale * x)``; ties go to the smaller id.
    """
    shards = staged(_packed(vectors, vec_id, vector, scale, SHARD), "shards")
    wanted = staged(_packed(queries.select(vec_id, vector).distinct(), vec_id, vector, scale,
                            QUERIES), "queries")
    slots = max(1, shards.count())
    # Every block of queries meets every slot; a shard lies in one slot.
    slotted = shards.select(F.pmod(F.xxhash64("part"), F.lit(slots)).alias("slot"), "dims",
                            "wide", "ids", "cells")
    asked = wanted.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast(
        "long"))).alias("slot"), "dims", F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"),
        F.col("cells").alias("q"))
    met = asked.join(slotted, ["slot", "dims"]).select("dims", "q_wide", "q_ids", "q", "wide",
                                                       "ids", "cells")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, q_wide, q_ids, q, wide, ids, cells = (
                    batch.column(c)[i].as_py() for c in range(7))
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q = np.frombuffer(q, _cells(q_wide)).reshape(-1, dims)
                x = np.frombuffer(cells, _cells(wide)).reshape(-1, dims)
                if _largest(q, x) < LONG:
                    best, who, _ = search_shard(q_ids, q, ids, x, k)
                else:
                    best, who = search_large(q_ids, q, ids, x, k)
                at = np.flatnonzero(best.ravel() != NONE)
                query = np.repeat(np.arange(len(q)), k)[at]
                vectors_of = [row.tobytes() for row in q]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[query]), pa.array([vectors_of[j] for j in query], pa.binary()),
                     pa.array(who.ravel()[at]), pa.array(best.ravel()[at])],
                    names=["query_id", "asked", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, asked binary, vec_id long, score long")
    # Spark keeps k rows per query on the map side before this window's shuffle.
    best = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
