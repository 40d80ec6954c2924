"""Text quality from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled text. A document is cut into
pieces, so that a dictionary counts for all of a long text, and each piece is
compressed with either dictionary. The normalised difference of the two sums,
``(bad - good) / max(bad, good)``, says which kind of text it resembles; the
compressed share of its bytes says whether it resembles anything but itself
(text that repeats a word shrinks alike under both). A logistic fit of both on
labelled documents that the dictionaries have not seen turns them into the
probability of label 1.

Fitting uses up to ``documents`` documents of each label, those with the smallest
id hashes, and up to ``pieces`` pieces of their text; class weights restore the
labels' true shares. The driver gets those pieces and two numbers per document.

Defined cases: a null text scores as an empty one; without labels of both kinds
the score is the share of label 1 (0.5 with no label at all); labels other than 0
and 1 are ignored; an id with several labels has its smallest; a null id is held
out and never learned from; rows that repeat score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.language_id import fold
from loopweave.session import staged

PIECE = 1024
DICTIONARY = 64 << 10
LEVEL = 3
DOCUMENTS = 4000
PIECES = 6000


def _pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[:DICTIONARY]


class Compressors:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                write_dict_id=False))
        self.frame = len(self.packers[0].compress(b""))

    def features(self, text: str | None) -> tuple[float, float]:
        parts = _pieces(text)
        good, bad = (max(1, sum(len(p.compress(x)) - self.frame for x in parts))
                     for p in self.packers)
        size = sum(map(len, parts))
        # Constants keep very short texts near the middle.
        return (bad - good) / max(bad, good), float(np.log((min(good, bad) + 8) / (size + 16)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weighted logistic regression with a slight ridge, by damped Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.array([1e-3] * (x.shape[1] - 1) + [1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(ridge), gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray | None  # of the difference, the compressed share, and a constant
    share: float  # of label 1

    def scorer(self):
        if self.weights is None:
            return lambda text: (self.share, 0.0, 0.0)
        compressors, w = Compressors(self.good, self.bad), self.weights

        def score(text: str | None) -> tuple[float, float, float]:
            d, r = compressors.features(text)
            return float(1 / (1 + np.exp(-np.clip(d * w[0] + r * w[1] + w[2], -35, 35)))), d, r

        return score


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", documents: int = DOCUMENTS, pieces: int = PIECES) -> Model:
    """Learn from the labelled documents; ``labels`` holds the rows to learn from."""
    spark = docs.sparkSession
    known = (labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_label")))
    drawn = F.xxhash64("_id", F.lit(5))
    taken = [known.filter(F.col("_label") == k).orderBy(drawn, "_id").limit(documents)
             for k in (0, 1)]
    sample = staged(taken[0].union(taken[1]).withColumn(
        "_part", F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(2)).cast("int")), "sample")
    totals = {r._label: r.n for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5

    # The sample is small and its size is known, so Spark broadcasts it by itself.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(
        sample, "_id")
    rows = staged(rows, "labelled")
    held = {(r._label, r._part) for r in rows.select("_label", "_part").distinct().collect()}
    if not {0, 1} <= {k for k, _ in held}:
        return Model(b"", b"", None, share)
    halves = len(held) == 4  # else there are too few to keep some back

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(*(batch.column(c).to_pylist() for c in range(2))):
                parts = _pieces(content)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()),
                     pa.array(parts, pa.binary())], names=["doc", "at", "piece"])

    dictionaries = []
    for k in (1, 0):
        of = rows.filter(F.col("_label") == k)
        cutting = (of.filter("_part = 0") if halves else of).select(F.col("_id").cast("long"), "text")
        found = (cutting.mapInArrow(cut, "doc long, at int, piece binary")
                 .orderBy(F.xxhash64("doc", "at"), "doc", "at").limit(pieces).collect())
        dictionaries.append(_dictionary([bytes(r.piece) for r in found]))
    model = Model(*dictionaries, np.zeros(3), share)
    seen = _scored(rows.filter("_part = 1") if halves else rows, model, "_id", "text", "_label")
    points = np.array([(r.difference, r.shrunk, r._label) for r in seen.collect()])
    y = points[:, 2]
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    model.weights = logistic(points[:, :2], y, weight / weight.mean())
    return model


def _scored(docs: DataFrame, model: Model, doc_id: str, text: str, *more: str) -> DataFrame:
    # Plain values: what is broadcast must load without this package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(**shared.value).scorer()
        for batch in batches:
            found = [scorer(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], *[pa.array(c, pa.float64()) for c in columns]],
                names=[doc_id, *more, "score", "difference", "shrunk"])

    rows = docs.select(F.col(doc_id), F.col(text).cast("string").alias("text"), *more)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(score, kept + ", score double, difference double, shrunk double")


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """doc_id, score, difference, shrunk, predicted for every document."""
    return _scored(docs, model, doc_id, text).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def held_out_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Learn from two thirds of the ids, score all: adds ``held_out``."""
    model = fit(docs, labels.filter(fold(doc_id) != 1), doc_id, text)
    return score_quality(docs, model, doc_id, text).select(
        doc_id, (fold(doc_id) == 1).alias("held_out"), "score", "predicted", "difference",
        "shrunk")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    # Plain values: what is broadcast must load without this package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(**shared.value).scorer()
        for batch in batches:
            texts = batch.column("row").field(text)
            yield batch.filter(pa.array([scorer(t.as_py())[0] >= 0.5 for t in texts], pa.bool_()))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.mapInArrow(keep, whole.schema).select("row.*")
