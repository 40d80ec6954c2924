"""Language identification by the nearest of several centroids per language.

A text becomes the vector of its letter trigrams (bytes of the lower-cased text,
everything between words a single space), hashed to DIMS buckets, weighted by
TF-IDF and scaled to length one. Each language is clustered into up to CLUSTERS
centroids by spherical k-means; a text takes the language of the centroid with
the largest cosine. It is rejected where its distance exceeds the centroid's
radius, the largest distance among the texts it was fitted on, plus a margin.

Document frequencies cover every document of the learning fold. Centroids are
fitted on about ``sample`` documents of each language, drawn by a hash of the id;
each language is one bounded group. The model (languages x clusters x DIMS) is
what the driver holds and the tasks get.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any learned language every text is ``und``; a null id is held out; a
language with fewer texts than clusters has as many centroids as texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.llm.words import text_bytes

DIMS = 4096
CLUSTERS = 4
SAMPLE = 400  # documents of a language that its centroids are fitted on, about
MARGIN = 1.25  # of a centroid's radius
SHARPNESS = 25.0  # of the score over the languages' best cosines
BLOCK = 256  # documents vectorised at once
UNKNOWN = "und"

_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 for a null id, so that it is never learned from."""
    text = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(text.cast("string").cast("binary")), F.lit(3)), F.lit(1))


def trigram_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of up to BLOCK rows: how often each trigram bucket occurs in each text."""
    for begin in range(0, len(texts), BLOCK):
        part = texts.slice(begin, BLOCK)
        raw, offsets = text_bytes(pc.utf8_lower(part))
        n = len(part)
        # A space before and after every text, and one for each run between words.
        data = np.insert(np.where(_LETTER[raw], raw, 32).astype(np.uint8),
                         np.concatenate([offsets[:-1], offsets[1:]]), 32)
        owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
        keep = np.ones(len(data), dtype=bool)
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])
        data, owner = data[keep].astype(np.uint32), owner[keep]
        whole = owner[2:] == owner[:-2]
        code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:])[whole]
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS.bit_length() + 1)
        yield np.bincount(owner[2:][whole] * DIMS + bucket,
                          minlength=n * DIMS).reshape(n, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; a row without trigrams stays zero."""
    x = np.log1p(counts).astype(np.float32) * idf
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, radii) by spherical k-means from farthest-first centres."""
    centres = [x.mean(axis=0)]
    centres = [x[int(np.argmax(x @ centres[0]))]]
    while len(centres) < min(k, len(x)):
        nearest = np.max(x @ np.stack(centres).T, axis=1)
        centres.append(x[int(np.argmin(nearest))])
    c = np.stack(centres)
    for _ in range(rounds):
        mine = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[mine == j].sum(axis=0) if (mine == j).any() else c[j]
                         for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = x @ c.T
    mine = np.argmax(near, axis=1)
    radii = np.array([1 - near[mine == j, j].min() if (mine == j).any() else 0.0
                      for j in range(len(c))])
    return c.astype(np.float32), radii.astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    radii: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, distance, rejected) of each row."""
        near = vectors(counts, self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        cosine = near[np.arange(len(near)), best]
        per = np.stack([near[:, self.owner == i].max(axis=1)
                        for i in range(len(self.languages))], axis=1)
        weight = np.exp(SHARPNESS * (per - per.max(axis=1, keepdims=True)))
        score = 1.0 / weight.sum(axis=1)
        return self.owner[best], score, 1 - cosine, 1 - cosine > MARGIN * self.radii[best]


def fit(learn: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model | None:
    """Learn from rows with a text and a language; None where there are none."""
    rows = learn.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                        F.col(lang).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS, dtype=np.int64)
        for batch in batches:
            for counts in trigram_counts(batch.column(0)):
                total += (counts > 0).sum(axis=0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])],
                                         names=["bucket", "n"])

    found = rows.select("text").mapInArrow(frequencies, "bucket long, n long")
    df = np.zeros(DIMS)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most DIMS rows
        df[r.bucket] = r.n
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)

    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rates = rows.sparkSession.createDataFrame(
        [(k, min(1.0, sample / n)) for k, n in sizes.items()], "lang string, rate double")
    sampled = rows.join(rates, "lang").filter(drawn < F.col("rate")).select("lang", "text")

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for counts in trigram_counts(batch.column(1)):
                x = vectors(counts, idf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)),
                     pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])
                at += len(x)

    def centre(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(b, np.float32) for b in table["x"].to_pylist()])
        x = x[np.lexsort(x.T[:8])]  # the same order on every run
        c, radii = cluster(x[np.abs(x).sum(axis=1) > 0], clusters) if np.abs(x).sum() else (
            np.zeros((0, DIMS), np.float32), np.zeros(0, np.float32))
        return pa.table({"lang": [table["lang"][0].as_py()] * len(c),
                         "x": pa.array([r.tobytes() for r in c], pa.binary()),
                         "radius": pa.array(radii.astype(np.float64))})

    fitted = (sampled.mapInArrow(vectorise, "lang string, x binary").groupBy("lang")
              .applyInArrow(centre, "lang string, x binary, radius double").collect())
    if not fitted:
        return None
    fitted.sort(key=lambda r: (r.lang, r.x))
    languages = sorted({r.lang for r in fitted})
    return Model(idf, languages, np.array([languages.index(r.lang) for r in fitted]),
                 np.stack([np.frombuffer(r.x, np.float32) for r in fitted]),
                 np.array([r.radius for r in fitted], np.float32))


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, distance, rejected for every document."""
    # Plain arrays: what is broadcast must load without this package.
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value and Model(**shared.value)
        for batch in batches:
            texts, at = batch.column(1), 0
            if not batch.num_rows:
                continue
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(
                zero_copy_only=False)
            if m is None:
                n = len(texts)
                yield _result(batch.column(0), np.full(n, UNKNOWN, object), np.zeros(n),
                              np.ones(n), np.ones(n, bool))
                continue
            names = np.array(m.languages, dtype=object)
            for counts in trigram_counts(texts):
                n = len(counts)
                which, score, distance, far = m.predict(counts)
                known = letters[at:at + n]
                yield _result(batch.column(0).slice(at, n),
                              np.where(known, names[which], UNKNOWN), np.where(known, score, 0.0),
                              np.where(known, distance, 1.0), far | ~known)
                at += n

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, "
                                    "distance double, rejected boolean")


def _result(ids, names, score, distance, rejected) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(names, pa.string()), pa.array(score.astype(np.float64)),
         pa.array(distance.astype(np.float64)), pa.array(rejected)],
        names=["doc_id", "lang_pred", "score", "distance", "rejected"])


def held_out_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       lang: str = "lang") -> DataFrame:
    """Learn from two thirds of the ids, predict for all: adds ``held_out``."""
    model = fit(docs.filter(fold(doc_id) != 1), doc_id, text, lang)
    return identify(docs, model, doc_id, text).select(
        "doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score", "distance",
        "rejected")
