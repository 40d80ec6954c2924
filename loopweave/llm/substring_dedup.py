"""Removal of repeated token windows: Rabin-Karp hashes, counted over the whole corpus.

A window is a fixed number of consecutive words of one document. Every word that
lies in a window whose words also start earlier (in a document with a smaller id,
or earlier in the same document) is removed. Windows are judged on the input.

Documents are range-partitioned by id, so partitions are in the order of the
corpus; inside one, runs of documents form blocks. A task computes the
Rabin-Karp hash of every window of a block. Repeats inside the block are settled
there, and one hash stands for all of them, so a passage that half of all
documents share costs each block one entry. The distinct hashes go to ranges of
the hash space, sorted, as compressed differences. There they are counted: a hash
that several blocks hold belongs to the first one, and the others are told, by a file
for each partition below the shared folder. So a task of the last pass needs a single
Python worker: one that zips texts and messages would hold three at once. Each
block then merges its windows that start earlier elsewhere into maximal intervals
of words, which are cut out.

The words travel once, in the range partitioning; both passes over them read the
same shuffle files, which Spark makes again from the table when an executor is
lost. Memory is bounded by the bytes of a partition: their number follows the
size of the text. Hash equality stands for equality of windows; two different
ones agree with a probability of about 2**-60.

Defined cases: a null text has no words and an empty rest; a text shorter than a
window keeps all its words; a null id comes last; documents that share an id are
ordered by the hash of their text, and rows that repeat wholly are documents of
their own, of which the first keeps its words; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.naming import unique_name
from loopweave.llm.words import BLACK, mix, power_tables, words_of
from loopweave.session import scratch_path
from loopweave.sources.stores import store

WINDOW = 20
PARTITION_BYTES = 48 << 20  # of text; a longer text is a partition of its own
BLOCK_BYTES = 4 << 20  # of text; a longer text is a block of its own

_U = np.uint64
_BASE_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of all windows inside the texts ``words[first[i]:first[i + 1]]``.

    The hash of a window is a polynomial in its word hashes; each follows from the
    one before through running sums.
    """
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * power[:n], out=sums[1:])
    hashes = mix((sums[width:] - sums[:-width]) * inverse[:n - width + 1])
    crosses = np.zeros(n + width, dtype=bool)
    for back in range(1, width):  # windows that would run into the next text
        at = first[1:-1] - back
        crosses[at[at >= 0]] = True
    places = np.flatnonzero(~crosses[:n - width + 1])
    return hashes[places], places


def packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as compressed differences, byte plane by byte plane."""
    apart = np.diff(hashes, prepend=_U(0))
    planes = np.ascontiguousarray(apart.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def in_blocks(rows: Iterable, most: int = BLOCK_BYTES) -> Iterator[list]:
    """Runs of (doc_id, text) rows with about ``most`` bytes; the same runs on every pass."""
    run, size = [], 0
    for row in rows:
        length = len(row[1] or "")
        if run and size + length > most:
            yield run
            run, size = [], 0
        run.append((row[0], row[1] or ""))
        size += length
    if run:
        yield run


def noted(partition: int, messages: Iterable, path: str) -> Iterator[tuple[int, str]]:
    """(partition, file): what a partition's blocks hear, in one file below the shared ``path``."""
    by_block: dict[int, list[bytes]] = {}
    for _, (block, hashes) in messages:
        by_block.setdefault(block, []).append(hashes)
    if by_block:
        files, folder = store(path)
        files.create_dir(folder, recursive=True)
        name = unique_name(f"heard-{partition:06d}", ".bin")
        with files.open_output_stream(f"{folder}/{name}") as out:
            out.write(pickle.dumps(by_block, 5))
        yield partition, name


def read_notes(path: str, name: str | None) -> dict[int, list[bytes]]:
    """The hashes each block of a partition hears, by block, as packed."""
    if name is None:
        return {}
    files, folder = store(path)
    with files.open_input_file(f"{folder}/{name}") as source:
        return pickle.loads(source.read())


def _windows_of(run: list, width: int):
    words, first = words_of(pa.array([t for _, t in run], pa.large_string()), BLACK, lower=False)
    hashes, places = window_hashes(words, first, width)
    return hashes, places, first


def told_hashes(partition: int, rows: Iterable, width: int, ranges: int
                ) -> Iterator[tuple[int, tuple[int, int, bytes]]]:
    """(range, (partition, block, hashes)): the distinct windows of each block, by hash range."""
    for block, run in enumerate(in_blocks(rows)):
        hashes = np.unique(_windows_of(run, width)[0])
        of = ((hashes >> _U(32)) * _U(ranges)) >> _U(32)
        edges = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))
        for r in np.flatnonzero(np.diff(edges)):
            yield int(r), (partition, block, packed(hashes[edges[r]:edges[r + 1]]))


def repeats(told: Iterable) -> Iterator[tuple[int, tuple[int, bytes]]]:
    """(partition, (block, hashes)) for hashes of one range that an earlier block holds, too."""
    messages = sorted((m for _, m in told), key=lambda m: m[:2])
    if not messages:
        return
    arrays = [unpacked(m[2]) for m in messages]
    holder = np.repeat(np.arange(len(arrays), dtype=np.int32), [len(a) for a in arrays])
    hashes = np.concatenate(arrays)
    del arrays
    order = np.argsort(hashes, kind="stable")  # so holders of a hash stay in corpus order
    ordered = hashes[order]
    later = order[1:][ordered[1:] == ordered[:-1]]
    del order, ordered
    later = np.sort(later)
    edges = np.searchsorted(holder[later], np.arange(len(messages) + 1))
    for i in np.flatnonzero(np.diff(edges)):
        partition, block, _ = messages[i]
        yield partition, (block, packed(hashes[later[edges[i]:edges[i + 1]]]))


def cut(run: list, heard: np.ndarray, width: int) -> Iterator[tuple]:
    """(doc_id, n_words, n_removed, removed, kept) of a block's documents.

    ``heard``: the sorted hashes that an earlier block holds.
    """
    hashes, places, first = _windows_of(run, width)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    again = np.zeros(len(hashes), dtype=bool)
    again[order[1:]] = ordered[1:] == ordered[:-1]
    if len(heard):
        at = np.minimum(np.searchsorted(heard, hashes), len(heard) - 1)
        again |= heard[at] == hashes
    steps = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    np.add.at(steps, places[again], 1)
    np.add.at(steps, places[again] + width, -1)
    covered = np.cumsum(steps) > 0
    for i, (doc_id, text) in enumerate(run):
        low, high = int(first[i]), int(first[i + 1])
        words = text.encode().split()  # splits at just the bytes that are no word bytes
        changes = np.flatnonzero(np.diff(covered[low:high], prepend=False, append=False))
        removed, kept, at = [], [], 0
        for begin, end in zip(changes[::2].tolist(), changes[1::2].tolist()):
            removed.append((begin, end))
            kept += words[at:begin]
            at = end
        kept += words[at:]
        yield (doc_id, high - low, high - low - len(kept), removed, b" ".join(kept).decode())


def _partitions(docs: DataFrame, doc_id: str, text: str) -> RDD:
    """(doc_id, text) rows in range partitions whose order is the order of the corpus.

    The last key tells rows apart that repeat wholly, so that many of them spread
    over several partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"),
                       F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    order = [F.col("id").asc_nulls_last(), F.col("hash"), F.col("row")]
    keyed = rows.select("id", "text", F.xxhash64("text").alias("hash"),
                        F.monotonically_increasing_id().alias("row"))
    return keyed.repartitionByRange(count, *order).sortWithinPartitions(*order).select(
        "id", "text").rdd


def without_repeats(docs: DataFrame, width: int = WINDOW, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of every row.

    ``removed`` are the maximal runs of removed words, as [start, end); ``kept`` is
    the rest, its words joined by one space.
    """
    spark = docs.sparkSession
    rows = _partitions(docs, doc_id, text)
    count = rows.getNumPartitions()
    schema = ("doc_id long, n_words long, n_removed long,"
              " removed array<struct<start: long, end: long>>, kept string")
    if not count:
        return spark.createDataFrame([], schema)
    told = rows.mapPartitionsWithIndex(lambda i, part: told_hashes(i, part, width, count))
    heard = told.partitionBy(count, int).mapPartitions(repeats).partitionBy(count, int)
    path = scratch_path(spark, "heard")
    names = dict(heard.mapPartitionsWithIndex(lambda i, part: noted(i, part, path)).collect())

    def clean(partition, part):
        by_block = read_notes(path, names.get(partition))
        for block, run in enumerate(in_blocks(part)):
            heard_here = by_block.get(block)
            yield from cut(run, np.sort(np.concatenate([unpacked(h) for h in heard_here]))
                           if heard_here else np.zeros(0, np.uint64), width)

    return spark.createDataFrame(rows.mapPartitionsWithIndex(clean), schema, verifySchema=False)
