"""Resampling towards a target distribution, by importance weights of hashed word runs.

The features of a text are its runs of one to three words; a feature's bucket is
the CRC-32 of its bytes modulo the number of buckets. All documents give one
histogram of buckets, all target texts another; the logarithm of their smoothed
ratio is a bucket's gain, in thousandths, and a document's weight is the sum of
the gains of its features. Adding Gumbel noise that depends on the id alone and
taking the largest scores draws without replacement, in proportion to
exp(weight).

CRCs come from length-bucketed matrices: inside a task, the distinct features of
a stretch of text are grouped by their length in bytes; a group is a
two-dimensional uint8 array, whose CRCs are all updated at once, column by
column, and whose buckets are scattered back to every place of the features.
Two features are taken for the same one if their 64-bit hashes agree.

Texts never leave their task; a task sends one count for each of its buckets.
Memory is bounded by blocks of texts, stretches of words and the number of
buckets. Only the histograms (``buckets`` numbers) reach the driver. Ranks come
from range partitions on the whole order.

Defined cases: a null or wordless text has no features and weight 0; a null id
is noise-hashed as an empty one and ranks last among equal scores; rows that
repeat are documents of their own, with equal weights and ranks next to each
other; an empty target or an empty table leaves gains that are defined by the
smoothing, and an empty result for an empty table. Other columns, whatever their
names, are carried by ``resample``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.words import ALNUM, blocks, mix, power_tables, text_bytes
from loopweave.operators.dimensions import ordered_ids
from loopweave.session import staged

BUCKETS = 10_000
LONGEST_RUN = 3  # words of a feature
STRETCH = 1 << 20  # bytes of text whose features are worked on at a time
FEW = 24  # features of one length from which on a matrix pays

#: The byte-wise table of the CRC-32 of zlib and Ethernet, from its polynomial.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(61).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def spaced_words(raw: np.ndarray, chunk: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, places) of the lower-cased words, each followed by one space.

    ``starts`` has one more entry than there are words: word ``i`` is
    ``bytes[starts[i]:starts[i + 1] - 1]``. ``places`` are the words' first bytes
    in ``raw``, which has to end between words.
    """
    pieces, starts, places, size, before = [], [], [], 0, False
    for begin in range(0, len(raw), chunk):
        data = _LOWER[raw[begin:begin + chunk]]
        inside = ALNUM[data]
        earlier = np.empty(len(inside), dtype=bool)
        earlier[0], earlier[1:] = before, inside[:-1]
        before = bool(inside[-1])
        kept = inside | earlier
        first = np.flatnonzero(inside & ~earlier)
        starts.append(np.cumsum(kept)[first] - 1 + size)
        places.append(first + begin)
        pieces.append(np.where(inside, data, 32).astype(np.uint8)[kept])
        size += len(pieces[-1])
    starts.append(np.array([size]))
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint8),
            np.concatenate(starts).astype(np.int64),
            np.concatenate(places) if places else np.zeros(0, np.int64))


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices ``data[starts:starts + lengths]``, one matrix for each length."""
    out = np.empty(len(starts), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for low, high in zip(edges[:-1], edges[1:]):
        rows, length = order[low:high], int(lengths[order[low]])
        if len(rows) < FEW:
            for r in rows:
                out[r] = zlib.crc32(data[starts[r]:starts[r] + length])
            continue
        matrix = np.lib.stride_tricks.sliding_window_view(data, length)[starts[rows]]
        state = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            state = _CRC[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
        out[rows] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of one stretch."""
    if len(data) > STRETCH:
        power, inverse = power_tables(len(data) + 1)
    else:
        if not _TABLES:
            _TABLES[0] = power_tables(STRETCH + 1)
        power, inverse = _TABLES[0]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def stretches(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, buckets: int,
              longest: int = LONGEST_RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each distinct feature, its index at every place, owner of every place)."""
    words, begin = len(starts) - 1, 0
    while begin < words:
        end = int(np.searchsorted(starts, starts[begin] + STRETCH, side="right")) - 1
        end = min(words, max(begin + 1, end - longest + 1))
        last = min(words, end + longest - 1)
        base = starts[begin]
        piece = data[base:starts[last]]
        at = np.arange(begin, end)
        froms, untils, owners = [], [], []
        for n in range(1, longest + 1):
            of = at[at + n <= words]
            of = of[owner[of] == owner[of + n - 1]]
            froms.append(starts[of] - base)
            untils.append(starts[of + n] - 1 - base)
            owners.append(owner[of])
        low, high = np.concatenate(froms), np.concatenate(untils)
        _, index, back = np.unique(_hashes(piece, low, high), return_index=True,
                                   return_inverse=True)
        found = crcs(piece, low[index], (high - low)[index]) % np.uint32(buckets)
        yield found.astype(np.int64), back, np.concatenate(owners)
        begin = end


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, owner) of the words of a block of texts."""
    raw, offsets = text_bytes(texts)
    # One byte between texts, so that words of neighbours stay apart.
    apart = np.full(len(raw) + len(offsets) - 1, 10, dtype=np.uint8)
    for i in range(len(offsets) - 1):
        apart[offsets[i] + i:offsets[i + 1] + i] = raw[offsets[i]:offsets[i + 1]]
    data, starts, places = spaced_words(apart)
    edges = offsets[1:] + np.arange(len(offsets) - 1)  # the byte after each text
    return data, starts, np.searchsorted(edges, places, side="right")


def histogram(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that any falls into."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch, 0):
                for found, back, _ in stretches(*_words(block.column(0)), buckets):
                    np.add.at(totals, found, np.bincount(back, minlength=len(found)))
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[seen])], ["bucket", "n"])

    parts = texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for row in counts.collect():  # at most one row for each bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, text: str = "text"
          ) -> list[int]:
    """Thousandths of the log ratio of target to documents, one for each bucket."""
    source, wanted = (_dense(histogram(t, text, buckets), buckets) for t in (docs, target))
    n_source, n_wanted = sum(source), sum(wanted)
    return [math.floor(1000 * math.log(float(t + 1) * float(n_source + buckets)
                                       / (float(s + 1) * float(n_wanted + buckets))))
            for s, t in zip(source, wanted)]


def weigh(docs: DataFrame, gain: list[int], carry: str | None = None, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; ``carry`` names a struct of the row."""
    table = np.array(gain, dtype=np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                n = block.num_rows
                data, starts, owner = _words(block.column(1))
                features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for found, back, owners in stretches(data, starts, owner, len(table)):
                    features += np.bincount(owners, minlength=n)
                    # Sums of whole numbers far below 2**53, so exact as doubles.
                    weight += np.bincount(owners, table[found][back], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(np.bincount(owner, minlength=n)),
                     pa.array(features), pa.array(weight), *block.columns[2:]],
                    ["doc_id", "n_words", "n_features", "weight", *block.schema.names[2:]])

    columns = [F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")]
    schema = "doc_id long, n_words long, n_features long, weight long"
    if carry:
        columns.append(F.struct("*").alias(carry))
        schema += f", {carry} {docs.select(columns[-1]).schema[0].dataType.simpleString()}"
    return docs.select(*columns).mapInArrow(score, schema)


def scored(weights: DataFrame, seed: int = 42) -> DataFrame:
    """Add ``score``: the weight plus the Gumbel noise of the id, in thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + noise.cast("long"))


def _ranked(scores: DataFrame) -> DataFrame:
    """Add ``place``, from 1: largest score first, then the smaller id."""
    order = ["_down", "doc_id", "n_features", "n_words"]
    return ordered_ids(scores.withColumn("_down", -F.col("score")), order, "place",
                       nulls_last=True).drop("_down")


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20,
         seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document.

    ``percent`` of the documents with ``least_words`` words, rounded down, are
    drawn and have a rank; all others have none.
    """
    scores = staged(scored(weigh(docs, gains(docs, target, buckets)), seed), "scores")
    fit = F.col("n_words") >= least_words
    drawn = percent * scores.filter(fit).count() // 100
    rank = F.when(F.col("place") <= drawn, F.col("place").cast("long"))
    ranked = _ranked(scores.filter(fit)).withColumn("rank", rank).drop("place")
    return ranked.unionByName(
        scores.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20,
             seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """The drawn documents themselves, with all their columns.

    Scores find the last one drawn; only rows that reach it carry their text
    into the ranking.
    """
    gain = gains(docs, target, buckets)
    scores = staged(scored(weigh(docs, gain), seed), "scores").filter(
        F.col("n_words") >= least_words)
    drawn = percent * scores.count() // 100
    last = _ranked(scores).filter(F.col("place") <= drawn).agg(F.min("score")).first()[0]
    if last is None:
        return docs.limit(0)
    near = scored(weigh(docs, gain, "carried"), seed).filter(
        (F.col("n_words") >= least_words) & (F.col("score") >= last))
    return _ranked(near).filter(F.col("place") <= drawn).select("carried.*")
