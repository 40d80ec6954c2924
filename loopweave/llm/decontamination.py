"""Benchmark decontamination with suffix arrays over the training text.

Each task turns bounded runs of its documents (shards) into a word-level suffix
array and binary-searches the suffixes of the benchmark in it: those that begin with
equal windows are one search. A hit place is extended to the longest verbatim match
with any item, found in the order of the benchmark's own suffixes. Documents never
leave their task, so nothing is shuffled, and no hot source or copied passage
concentrates work.

Memory follows the text, however often words repeat in it: a place meets one window
of each length, places keep one longest match each, and only items are listed beside
them.

Defined cases: a null or word-less text has no words and no matches; an item without
words is ignored; items without an id count together as one, which has no id to be
listed; items that repeat an id share it; rows that repeat are judged each for itself;
an empty benchmark matches nothing. Other columns are carried along whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopweave.session import staged
from loopweave.llm.words import ALNUM, blocks, mix, power_tables, words_of

WINDOW = 10
SHARD_WORDS = 1 << 19  # of one suffix array; about 40 MB with its temporaries
PIECE_BYTES = 32 << 20  # benchmark text broadcast at once

MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("item_start", T.IntegerType()),
    T.StructField("doc_start", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` tokens, by prefix doubling.

    Each round doubles the sorted length and sorts again only the suffixes that
    still share a rank with another one.
    """
    n = len(tokens)
    order = np.argsort(tokens)
    ranks = np.zeros(n + 1, dtype=np.int64)  # the rank past the end is 0, the smallest
    ordered = tokens[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    firsts = np.flatnonzero(new)
    ranks[order] = np.repeat(firsts, np.diff(np.append(firsts, n))) + 1
    known = 1
    while known < depth:
        alone = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        members = order[open_at]
        group = ranks[members]
        following = ranks[np.minimum(members + known, n)]
        by = np.argsort(group * (n + 1) + following)  # n is small: no overflow
        members, group, following = members[by], group[by], following[by]
        order[open_at] = members
        fresh = np.ones(len(members), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
        new[open_at] = fresh
        heads = np.flatnonzero(fresh)
        # A group's rank is the place of its first member in the whole order.
        ranks[members] = np.repeat(open_at[heads], np.diff(np.append(heads, len(members)))) + 1
        known *= 2
    return order


def _bounds(tokens: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, at: int,
            wanted: np.ndarray, right: bool) -> np.ndarray:
    """Vectorised binary search, per query, inside [low, high) of the suffix array."""
    low, high = low.copy(), high.copy()
    last = len(tokens) - 1
    while True:
        going = low < high
        if not going.any():
            return low
        middle = (low + high) >> 1
        place = order[np.minimum(middle, last)] + at
        found = tokens[np.minimum(place, last)]
        less = (found <= wanted) if right else (found < wanted)
        less |= place > last
        # A suffix that ended sorts first, so it lies before every token.
        low = np.where(going & less, middle + 1, low)
        high = np.where(going & ~less, middle, high)


def find_windows(tokens: np.ndarray, order: np.ndarray, windows: np.ndarray,
                 lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every occurrence. Row i of ``windows`` has ``lengths[i]`` tokens."""
    ordered = tokens[order]
    low = np.searchsorted(ordered, windows[:, 0], side="left")
    high = np.searchsorted(ordered, windows[:, 0], side="right")
    active = np.flatnonzero(low < high)
    for at in range(1, windows.shape[1]):
        longer = active[lengths[active] > at]
        if not len(longer):
            break
        wanted = windows[longer, at]
        left = _bounds(tokens, order, low[longer], high[longer], at, wanted, False)
        right = _bounds(tokens, order, left, high[longer], at, wanted, True)
        low[longer], high[longer] = left, right
        active = active[low[active] < high[active]]
    counts = high[active] - low[active]
    total = int(counts.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(active, counts), order[np.repeat(low[active], counts) + inside]


class Windows:
    """The distinct windows of a piece of the benchmark, and where its items hold them.

    ``tokens`` are the items' words one item after another, with a zero behind each.
    The windows' occurrences are listed in the order of the suffixes that begin there,
    so those of window ``g`` are neighbours: ``low[g]:high[g]``. Windows that occur in
    the same items have the same ``group``.
    """

    def __init__(self, ids: list[int | None], texts: list[str], window: int):
        hashes, first = words_of(pa.array(texts, pa.string()), ALNUM)
        sizes, n = np.diff(first), len(ids)
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        self.named = np.array([i is not None for i in ids], dtype=bool)
        self.tokens = np.insert(hashes, first[1:], np.uint64(0))
        begins, ends = first[:-1] + np.arange(n), first[1:] + np.arange(n)
        lengths = np.minimum(sizes, window)
        many = np.where(sizes > 0, sizes - lengths + 1, 0)
        item = np.repeat(np.arange(n), many)
        place = begins[item] + _counting(many)
        rank = np.empty(len(self.tokens), dtype=np.int64)
        rank[suffix_array(self.tokens, int(sizes.max(initial=0)) + 1)] = np.arange(len(rank))
        by = np.argsort(rank[place])
        item, place = item[by], place[by]
        length = lengths[item]
        new = np.ones(len(place), dtype=bool)
        new[1:] = length[1:] != length[:-1]
        last = max(len(self.tokens) - 1, 0)
        for i in range(window):
            token = self.tokens[np.minimum(place + i, last)]
            new[1:] |= (i < length[1:]) & (token[1:] != token[:-1])
        self.low = np.flatnonzero(new)
        self.high = np.append(self.low[1:], len(place)) if len(place) else self.low
        self.lengths = length[self.low]
        within = np.arange(window)
        self.windows = np.where(
            within < self.lengths[:, None],
            self.tokens[np.minimum(place[self.low][:, None] + within, last)] if len(place) else 0,
            np.uint64(0)).astype(np.uint64)
        self.item, self.place = item, place
        self.start, self.room = place - begins[item], ends[item] - place
        # Each item of each window once, by its first occurrence there.
        of = np.cumsum(new) - 1
        _, self.listed = np.unique(of * max(n, 1) + item, return_index=True)
        self.list_low = np.searchsorted(of[self.listed], np.arange(len(self.low)))
        self.list_high = np.append(self.list_low[1:], len(self.listed))[:len(self.low)]
        sums = np.zeros((len(self.low), 2), dtype=np.uint64)
        seeds = self.item[self.listed].astype(np.uint64)
        np.add.at(sums[:, 0], of[self.listed], mix(seeds + np.uint64(1)))
        np.add.at(sums[:, 1], of[self.listed], np.uint64(1))
        self.group = np.unique(sums, axis=0, return_inverse=True)[1].reshape(-1)


def _counting(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class _Extension:
    """Longest common prefixes of document suffixes and benchmark suffixes.

    Sums of words times powers stand for runs of words, as they do for words.
    """

    def __init__(self, hashes: np.ndarray, windows):
        self.hashes, self.w = hashes, windows
        power, self.inverse = power_tables(max(len(hashes), len(windows.tokens)) + 1)
        self.own, self.other = (
            np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(t) * power[:len(t)])])
            for t in (hashes, windows.tokens))

    def common(self, word: np.ndarray, room: np.ndarray, at: np.ndarray,
               known: np.ndarray) -> np.ndarray:
        """Words that document place ``word`` and occurrence ``at`` have in common."""
        place = self.w.place[at]
        low, high = known.copy(), np.minimum(room, self.w.room[at])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = ((self.own[word + middle] - self.own[word]) * self.inverse[word]
                    == (self.other[place + middle] - self.other[place]) * self.inverse[place])
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def longest(self, word: np.ndarray, room: np.ndarray, window: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
        """(words, occurrence) of the longest match at places that hold a window.

        Occurrences of a window are in the order of their suffixes, so a binary search
        finds the two neighbours of a document's suffix, and the longer match is theirs.
        """
        w = self.w
        known, first, end = w.lengths[window], w.low[window], w.high[window]
        low, high = first.copy(), end.copy()
        while (low < high).any():
            going = np.flatnonzero(low < high)
            middle = (low[going] + high[going]) >> 1
            size = self.common(word[going], room[going], middle, known[going])
            own = np.where(size < room[going], self.hashes[np.minimum(
                word[going] + size, len(self.hashes) - 1)], np.uint64(0))
            less = w.tokens[w.place[middle] + size] < own
            low[going] = np.where(less, middle + 1, low[going])
            high[going] = np.where(less, high[going], middle)
        before, after = np.maximum(low - 1, first), np.minimum(low, end - 1)
        one, two = self.common(word, room, before, known), self.common(word, room, after, known)
        return np.maximum(one, two), np.where(one >= two, before, after)


def _shards(first: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last document, first word, last word) of runs of about ``limit`` words.

    A document longer than that is cut into runs that overlap by ``overlap`` words.
    """
    doc, n = 0, len(first) - 1
    while doc < n:
        end = max(doc + 1, int(np.searchsorted(first, first[doc] + limit, side="right")) - 1)
        if end == doc + 1 and first[end] - first[doc] > limit:
            for begin in range(int(first[doc]), int(first[end]), limit):
                yield doc, end, begin, min(begin + limit + overlap, int(first[end]))
        else:
            yield doc, end, int(first[doc]), int(first[end])
        doc = end


EXPANDED = 1 << 20  # pairs of a window and an item that are listed at a time


def _items_hit(owner: np.ndarray, window: np.ndarray, windows) -> tuple[np.ndarray, np.ndarray]:
    """(hit, occurrence): for every document and every item hit there, one of its hits.

    Windows of the same items are listed once per document, and a bounded number of
    pairs at a time.
    """
    groups = int(windows.group.max(initial=0)) + 1
    _, some = np.unique(owner * groups + windows.group[window], return_index=True)
    counts = (windows.list_high - windows.list_low)[window[some]]
    items = len(windows.ids)
    seen, hits, at = (np.zeros(0, np.int64) for _ in range(3))
    total = np.cumsum(counts)
    begin = 0
    while begin < len(some):
        done = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + EXPANDED, side="right")))
        part, n = some[begin:end], counts[begin:end]
        hit = np.repeat(part, n)
        occurrence = windows.listed[np.repeat(windows.list_low[window[part]], n) + _counting(n)]
        pairs = owner[hit] * items + windows.item[occurrence]
        seen, first = np.unique(np.concatenate([seen, pairs]), return_index=True)
        hits, at = np.concatenate([hits, hit])[first], np.concatenate([at, occurrence])[first]
        begin = end
    return hits, at


def matches_of(hashes: np.ndarray, first: np.ndarray, windows: Windows,
               limit: int = SHARD_WORDS) -> dict[int, list[tuple[int | None, int, int, int]]]:
    """Per document: (item, start in the item, start in the document, words).

    These are the longest matches: at each place the longest one with any item, unless
    an earlier one reaches as far. Items that none of these names follow with a window
    of theirs, so every item that is hit is named.
    """
    width = windows.windows.shape[1]
    found: list[np.ndarray] = []
    for doc, end, begin, stop in _shards(first, limit, width - 1):
        if begin == stop or not len(windows.low):
            continue
        # A zero after every document keeps matches from crossing into the next one.
        edges = np.clip(first[doc + 1:end + 1], begin, stop) - begin
        tokens = np.insert(hashes[begin:stop], edges, np.uint64(0))
        order = suffix_array(tokens, width)
        which, place = find_windows(tokens, order, windows.windows, windows.lengths)
        shift = np.searchsorted(edges + np.arange(len(edges)), place)  # documents before it
        found.append(np.stack([place - shift + begin, which]))
    if not sum(part.shape[1] for part in found):
        return {}
    # Overlapping shards of one long document may report a window twice.
    word, window = np.unique(np.concatenate(found, axis=1), axis=1)
    owner = np.searchsorted(first, word, side="right") - 1
    size, at = _Extension(hashes, windows).longest(word, first[owner + 1] - word, window)
    by = np.lexsort((-size, word))
    by = by[np.append(True, word[by][1:] != word[by][:-1])]  # the longest at each place
    ends = (word + size)[by]
    by = by[ends > np.append(-1, np.maximum.accumulate(ends)[:-1])]
    hits, others = _items_hit(owner, window, windows)
    named = owner[by] * len(windows.ids) + windows.item[at[by]]
    unnamed = ~np.isin(owner[hits] * len(windows.ids) + windows.item[others], named)
    hits, others = hits[unnamed], others[unnamed]
    at = np.concatenate([at[by], others])
    size = np.concatenate([size[by], windows.lengths[window[hits]]])
    owner, word = (np.concatenate([x[by], x[hits]]) for x in (owner, word))
    item = windows.item[at]
    out: dict[int, list[tuple[int | None, int, int, int]]] = {}
    for doc, name, has, start, begin, n in zip(*(x.tolist() for x in (
            owner, windows.ids[item], windows.named[item], windows.start[at], word - first[owner],
            size))):
        out.setdefault(doc, []).append((name if has else None, start, begin, n))
    return out


def _pieces(benchmark: DataFrame, piece_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in pieces of a checked size; one, unless it is larger than that."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // piece_bytes) or 1
    for i in range(n):
        part = items if n == 1 else items.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = part.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield rows.column("item_id").to_pylist(), rows.column("text").to_pylist()


def _search(docs: DataFrame, text: str, windows) -> DataFrame:
    """(row, n_words, matches) -> the same with the matches of one benchmark piece added."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = SimpleNamespace(**windows.value)
        for whole in batches:
            for batch in blocks(whole, whole.column("row").field(text)):
                row = batch.column("row")
                hashes, first = words_of(row.field(text), ALNUM)
                found = matches_of(hashes, first, piece)
                earlier = batch.column("matches").to_pylist()
                lists = [(old or []) + [
                    dict(zip(("item_id", "item_start", "doc_start", "n_words"), m))
                    for m in found.get(i, ())] for i, old in enumerate(earlier)]
                yield pa.RecordBatch.from_arrays(
                    [row, pa.array(np.diff(first), pa.int64()),
                     pa.array(lists, batch.schema.field("matches").type)], schema=batch.schema)

    return docs.mapInArrow(search, docs.schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                 piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(row, n_words, matches): every document as a struct, its words, its longest matches.

    A benchmark of up to ``piece_bytes``, repeated rows dropped, is broadcast. A larger
    one is searched piece by piece, with a table written between the passes, so neither
    the driver nor a task ever holds more than one piece; matches are the longest ones
    with the items of a piece.
    """
    spark = docs.sparkSession
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.lit(0).cast("long").alias("n_words"),
                      F.array().cast(MATCH).alias("matches"))
    for i, (ids, texts) in enumerate(_pieces(benchmark, piece_bytes)):
        if i:
            out = staged(out, "searched")
        # Plain arrays: what is broadcast must load without this package.
        out = _search(out, text, spark.sparkContext.broadcast(vars(Windows(ids, texts, window))))
    return out


def words_hit(matches: str | Column) -> Column:
    """Words of the document inside any match: the length of the union of intervals."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["doc_start"].cast("long").alias("a"), (m["doc_start"] + m["n_words"]).cast("long").alias(
            "b"))))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(
        spans, state,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["upto"], x["a"]))
             ).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")),
        lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                  text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its words, the hit ones, and the items whose windows it holds."""
    found = find_matches(docs.select(doc_id, text), benchmark, text, window)
    items = F.array_sort(F.array_distinct(F.transform(
        "matches", lambda m: m["item_id"].cast("string"))))
    hit = words_hit("matches")
    return found.select(
        F.col(f"row.{doc_id}").alias("doc_id"), "n_words", hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """The documents without any match, with all their columns."""
    return (find_matches(docs, benchmark, text, window)
            .filter(F.size("matches") == 0).select("row.*"))
