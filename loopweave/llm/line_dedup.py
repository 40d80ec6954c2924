"""Line deduplication within one word edit, by a deletion-neighbourhood join.

Lines are sequences of words (runs without ASCII white space). Equal lines are
one class; its first line in (doc_id, line number) order stands for it. Two
classes are near if one word inserted, deleted or replaced turns one into the
other, and the longer has at least ``least_words`` words. Of equal lines the
first is kept; the first is dropped, too, if an earlier line is near to it.

A class emits its variants, each with one word left out, as hashed keys. Two
lines that differ by a replaced word have an equal variant with the same place
left out; two that differ by an inserted word meet where a variant equals the
whole other line. Within a key only the earliest line counts, so a key is one
minimum, however many lines share it. Distances are then verified on the words.

Before that, classes are sifted by a necessary condition: within one edit, the
first or the last half is untouched. Only classes that share a half with another
one go back to their text and emit variants, which leaves out almost all lines.

Defined cases: null and empty texts have no lines; lines without words are kept
and never compared; rows that repeat an id are one document whose lines at the
same place are compared as different lines only if their words differ; a null id
comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.sizes import sized
from loopweave.llm.words import (BLACK, blocks, mix, power_tables, split_words, text_bytes,
                                 words_of)
from loopweave.session import discard, staged

LEAST_WORDS = 10

_U = np.uint64
_NEWLINE = 10


class Sequences:
    """Hashes of runs of words: words ``a:b`` of a hashed text, in constant time each."""

    def __init__(self, hashes: np.ndarray):
        self.power, self.inverse = power_tables(len(hashes) + 2)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.power[:len(hashes)], out=self.sums[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b) + (b - a).astype(np.uint64))

    def without_each(self, a: int, b: int) -> np.ndarray:
        """Hashes of the run ``a:b`` with each of its words left out in turn."""
        at = np.arange(a, b)
        before = self.raw(np.full(b - a, a), at)
        after = self.raw(at + 1, np.full(b - a, b))
        return mix(before + after * self.power[at - a] + _U(b - a - 1))


def _lines(texts: pa.Array):
    """(word hashes, first word, end word, text, line number) of the lines with words."""
    raw, offsets = text_bytes(texts)
    hashes, first, starts = split_words(raw, offsets, BLACK, lower=False, places=True)
    breaks = np.flatnonzero(raw == _NEWLINE)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[owner]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    a = np.flatnonzero(new)
    return hashes, a, np.append(a[1:], len(hashes)), owner[a], line[a]


def hashed_lines(docs: DataFrame, doc_id: str, text: str, least_words: int) -> DataFrame:
    """(doc_id, line, words, hash, h0..h3): one row per line with words.

    h0..h3 are the keys of the halves that an edit leaves untouched, for lines
    of the length and of one word more; null below ``least_words - 1`` words.
    """

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                hashes, a, b, owner, line = _lines(batch.column(1))
                sequences, n = Sequences(hashes), b - a
                short = n < least_words - 1
                halves = []
                for half in (n // 2, (n + 1) // 2):  # ceil((n-1)/2), ceil(n/2)
                    size = half.astype(np.uint64)
                    halves.append(mix(sequences.of(a, a + half) * _U(2) + size))
                    halves.append(mix(sequences.of(b - half, b) * _U(2) + _U(1) + size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(line, pa.int32()),
                     pa.array(n, pa.int32()), pa.array(sequences.of(a, b).view(np.int64)),
                     *[pa.array(h.view(np.int64), mask=short) for h in halves]],
                    names=["doc_id", "line", "words", "hash", "h0", "h1", "h2", "h3"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.filter("text is not null").mapInArrow(
        hash_lines, "doc_id long, line int, words int, hash long, "
                    "h0 long, h1 long, h2 long, h3 long")


def _texts_of(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, line, hash, text): the wanted lines; each document is read once."""
    lists = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("hash").alias("hashes"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lists = sized(lists, wanted.count())
    joined = rows.join(lists, rows["doc_id"].eqNullSafe(lists["_id"])).select(
        "doc_id", "text", "hashes")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                texts = batch.column(1)
                hashes, a, b, owner, line = _lines(texts)
                own = Sequences(hashes).of(a, b).view(np.int64)
                out = []
                asked = [set(x) for x in batch.column(2).to_pylist()]
                split: tuple[int, list[str]] = (-1, [])
                for h, t, at in zip(own.tolist(), owner.tolist(), line.tolist()):
                    if h in asked[t]:
                        if split[0] != t:
                            split = t, texts[t].as_py().split("\n")
                        asked[t].discard(h)
                        out.append((batch.column(0)[t].as_py(), at, h, split[1][at]))
                columns = list(zip(*out)) or [()] * 4
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "line", "hash", "text"])

    return joined.mapInArrow(pick, "doc_id long, line int, hash long, text string")


def variants(lines: DataFrame, least_words: int) -> DataFrame:
    """(kind, key, doc_id, line, hash) of every line with one word left out.

    Kind 0 keys hold the place left out, kind 1 keys equal the whole shorter
    line's hash, kind 2 is the line's own hash.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 3):
                hashes, first = words_of(batch.column(3), BLACK, lower=False)
                sequences = Sequences(hashes)
                kinds, keys, rows = [], [], []
                own = batch.column(2).to_numpy()
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    if b - a >= least_words:
                        left = sequences.without_each(a, b)
                        placed = mix(left + np.arange(1, b - a + 1).astype(np.uint64) * _U(
                            0x9E3779B97F4A7C15))
                        kinds += [np.zeros(b - a, np.int8), np.ones(b - a, np.int8)]
                        keys += [placed.view(np.int64), left.view(np.int64)]
                        rows.append(np.full(2 * (b - a), i))
                    kinds.append(np.full(1, 2, np.int8))
                    keys.append(own[i:i + 1])
                    rows.append(np.full(1, i))
                which = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys)),
                     batch.column(0).take(which), batch.column(1).take(which),
                     batch.column(2).take(which)],
                    names=["kind", "key", "doc_id", "line", "hash"])

    return lines.mapInArrow(emit, "kind byte, key long, doc_id long, line int, hash long")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (hash, keeper) whose words are within one edit."""
    one = lines.select("hash", F.col("text").alias("a"))
    two = lines.select(F.col("hash").alias("keeper"), F.col("text").alias("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within_one_edit(a.as_py().encode().split(), b.as_py().encode().split())
                    for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["hash", "keeper"])

    return pairs.join(one, "hash").join(two, "keeper").select("hash", "keeper", "a", "b").mapInArrow(
        check, "hash long, keeper long")


def within_one_edit(a: list, b: list) -> bool:
    """At most one element inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def near_lines(docs: DataFrame, classes: DataFrame, doc_id: str, text: str,
               least_words: int) -> DataFrame:
    """(hash, keeper): classes near to an earlier one, with the earliest such class."""
    halves = classes.select("hash", F.explode(F.array_distinct(F.array(
        "h0", "h1", "h2", "h3"))).alias("half")).filter("half is not null")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    sifted = halves.join(shared, "half", "left_semi").select("hash").distinct()
    wanted = staged(classes.join(sifted, "hash").select("hash", "doc_id"), "sifted")
    found = _texts_of(docs, doc_id, text, wanted)
    # Where an id repeats, a line may be found twice.
    lines = staged(found.groupBy("hash").agg(F.min(F.struct("doc_id", "line", "text")).alias("x"))
                   .select("x.doc_id", "x.line", "hash", "x.text"), "lines")
    place = F.struct("doc_id", "line", "hash")
    emitted = variants(lines, least_words).select("kind", "key", place.alias("at"))
    # Replaced words: the earliest line of a key is near to every other one.
    keyed = staged(emitted, "variants")
    replaced = keyed.filter("kind = 0")
    first = replaced.groupBy("key").agg(F.min("at").alias("keeper"), F.count("*").alias("n"))
    by_replacing = replaced.join(first.filter("n > 1").drop("n"), "key").filter("at != keeper")
    # Inserted words: a variant of one line is the whole of another.
    whole = keyed.filter("kind = 2").select("key", F.col("at").alias("short"))
    longer = keyed.filter("kind = 1").select("key", "at")
    met = staged(longer.join(whole, "key"), "inserted")
    drop_long = met.filter("short < at").select("at", F.col("short").alias("keeper"))
    drop_short = met.groupBy(F.col("short")).agg(F.min("at").alias("keeper")).filter(
        "keeper < short").select(F.col("short").alias("at"), "keeper")
    links = by_replacing.select("at", "keeper").unionByName(drop_long).unionByName(drop_short)
    # Any verified earlier line drops a class; the earliest candidate is verified.
    best = links.groupBy("at").agg(F.min("keeper").alias("keeper")).select(
        F.col("at.hash").alias("hash"), F.col("keeper.hash").alias("keeper"))
    near = staged(_verified(best, lines), "near")
    discard(wanted, lines, keyed, met)
    return near


def judged_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines, classes): all lines with words, and the classes of equal lines.

    A class has its hash, its first line (doc_id, line) and ``keeper``, the hash
    of the earlier class that it is near to, or null if its first line is kept.
    """
    lines = staged(hashed_lines(docs, doc_id, text, least_words), "lines")
    classes = staged(lines.groupBy("hash").agg(
        F.min(F.struct("doc_id", "line")).alias("x"),
        *[F.min(f"h{i}").alias(f"h{i}") for i in range(4)]).select(
        "hash", "x.doc_id", "x.line", "h0", "h1", "h2", "h3"), "classes")
    near = near_lines(docs, classes, doc_id, text, least_words)
    return lines, classes.select("hash", "doc_id", "line").join(near, "hash", "left")


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document id: its lines with words, and what becomes of them.

    doc_id, n_lines, n_kept, n_exact (later copies), n_near, kept_md5 (of the
    numbers of the kept lines, counted from 0, comma-joined).
    """
    lines, classes = judged_lines(docs, doc_id, text, least_words)
    classes = staged(classes, "judged")
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    counted = lines.groupBy(F.col("doc_id").alias("_a")).agg(F.count("*").alias("n_lines"))
    firsts = classes.groupBy(F.col("doc_id").alias("_b")).agg(
        F.count(F.when(F.col("keeper").isNull(), 1)).alias("n_kept"),
        F.count("keeper").alias("n_near"),
        F.array_sort(F.collect_list(F.when(F.col("keeper").isNull(), F.col("line")))).alias("kept"))
    zero = F.lit(0).cast("long")
    joined = (ids.join(counted, F.col("doc_id").eqNullSafe(F.col("_a")), "left")
              .join(firsts, F.col("doc_id").eqNullSafe(F.col("_b")), "left"))
    n_lines, n_kept, n_near = (F.coalesce(c, zero) for c in ("n_lines", "n_kept", "n_near"))
    kept = F.array_join(F.coalesce(F.col("kept"), F.array().cast("array<int>")).cast(
        "array<string>"), ",")
    return joined.select("doc_id", n_lines.alias("n_lines"), n_kept.alias("n_kept"),
                         (n_lines - n_kept - n_near).alias("n_exact"), n_near.alias("n_near"),
                         F.md5(kept).alias("kept_md5"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        least_words: int = LEAST_WORDS) -> DataFrame:
    """All documents and columns, with the dropped lines taken out of the text."""
    _, classes = judged_lines(docs, doc_id, text, least_words)
    kept = classes.filter("keeper is null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("line").alias("_kept"))
    whole = docs.select(F.col(doc_id).cast("long").alias("_of"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(kept, F.col("_of").eqNullSafe(F.col("_id")), "left")
    left = F.array_join(F.filter(
        F.split(F.col(f"row.{text}"), "\n", -1),
        lambda line, i: F.coalesce(F.array_contains("_kept", i), F.lit(False))
        | ~line.rlike(r"[^\x20\x09-\x0D]")), "\n")
    return joined.select(*[left.alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
                           for c in docs.columns])
