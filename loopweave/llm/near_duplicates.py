"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gets a signature of components of 8 bits; two
components agree with the probability of the Jaccard similarity. Signatures are
cut into CHUNKS chunks of eight components, a long each. By the pigeonhole
principle, two signatures that differ in at most ``3 * CHUNKS - 1`` components
differ in at most two components of some chunk. So each signature is listed under
every chunk with every two components (ERRORS) left out, and all pairs within that
distance, which is FAR, meet under at least one equal key. The distance of the whole
signatures sifts the pairs that meet, by the same bound; the full sets confirm the
rest. A pair at similarity 0.8 lies beyond FAR about once in 39,000 times.

An exact bound on the similarity sifts too: a set's parities are PARITIES bits, each
telling whether an odd number of its shingles fall on it. Every bit in which two sets
differ takes a shingle that only one of them has, so the number of such bits, and the
difference of the sizes, are at most that of these shingles; where they are too many,
the pair can't be similar. The bits tell little about sets of far more shingles than
bits, which the distance alone sifts. The pairs of the last join, most of them just below
the similarity, are sifted again by FINE bits, made from the texts of their nodes.

Large groups: equal sets collapse to one node first (an aggregate). Then chunks are
taken a few at a time, and components contract in between: keys whose nodes lie in
one component already are done with. A key with two or three nodes gives all its
pairs. A larger one is reduced to one node for each of its components, and these
meet one of them, the key's hub. What links becomes the components of the next
step. Other hubs follow as long as that joins components. In the end, nodes that
share a key but lie in different components meet pairwise, in a join that has the
distance and the bound as condition, counts a pair under the first of its keys alone,
and leaves out the pairs within the largest component of the key. So a group of near copies
costs links in proportion to its size, and no link between components is lost.

Defined cases: null and word-less texts have an empty set and link with nothing;
rows that repeat a text are copies; rows that repeat an id with the same text
are one document; rows without an id link like all others, and null never becomes a
component's id, unless a group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.llm.components import components, joined
from loopweave.session import discard, forget, staged
from loopweave.llm.sizes import sized
from loopweave.llm.words import BLACK, blocks, mix, text_bytes, words_of

CHUNKS, CHUNK = 13, 8  # eight components make a long
ERRORS = 2  # components left out of a chunk
FAR = (ERRORS + 1) * CHUNKS - 1  # components that may differ: all such pairs share a key
#: Chunks whose keys are grouped at once: the first one alone joins most of a group of copies.
STEPS = [range(0, 1), range(1, 7), range(7, CHUNKS)]
PARITIES = 512  # bits of the exact bound on the similarity
FINE = 4096  # and of the bound on the many pairs of the last join
TASK_KEYS = 1_000_000  # keys that a task lists, so that they are combined in memory
WORTHWHILE = 0.1  # share of its pairs that a round with new hubs has to link for another one

_U = np.uint64
_MULTIPLIERS = np.random.default_rng(41).integers(1, 1 << 63, 512, dtype=np.uint64) * _U(2) + _U(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        total = mix(total * _U(0x9E3779B97F4A7C15) + hashes[i:n - width + 1 + i])
    return np.unique(mix(total + _U(width)))


def signature(members: np.ndarray, size: int) -> np.ndarray:
    """``size`` components of 8 bits: low bits of the least hash under each multiplier."""
    least = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    multipliers = _MULTIPLIERS[:size, None]
    for begin in range(0, len(members), 2048):
        part = multipliers * members[None, begin:begin + 2048]
        np.minimum(least, part.min(axis=1), out=least)
    return (mix(least) & _U(255)).astype(np.uint8)


def parities(members: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """Whether an odd number of members falls on each of ``bits`` places, as packed bits."""
    places = (members & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8))


PARITY_COLUMNS = [f"p{i}" for i in range(PARITIES // 64)]


def _sign_columns(chunks: int) -> list[str]:
    return [f"s{i}" for i in range(chunks)]


def set_hash(members: np.ndarray) -> int:
    return int(mix(members).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, chunks: int) -> DataFrame:
    """(doc_id, n_shingles, node, text_hash, s0, ..., p0, ...): one row per document, in its partition.

    ``node`` is a 64-bit hash of the whole set (two of 10^8 sets share one with a
    probability of 0.0003); an empty set has none. Eight components share a long of
    ``s0`` and so on, 64 parities one of ``p0`` and so on.
    """
    names = _sign_columns(chunks) + PARITY_COLUMNS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole, 1)):
            hashes, first = words_of(batch.column(1), BLACK)
            n = batch.num_rows
            signs = np.zeros((n, CHUNK * chunks), dtype=np.uint8)
            odd = np.zeros((n, PARITIES // 8), dtype=np.uint8)
            counts, nodes = [], []
            for i in range(n):
                members = shingles(hashes[first[i]:first[i + 1]], width)
                counts.append(len(members))
                nodes.append(set_hash(members) if len(members) else None)
                signs[i], odd[i] = signature(members, CHUNK * chunks), parities(members)
            longs = np.hstack([signs.view(np.int64), odd.view(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()),
                 batch.column(2), *[pa.array(np.ascontiguousarray(longs[:, j])) for j in range(len(names))]],
                names=["doc_id", "n_shingles", "node", "text_hash", *names])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(F.col(text)).alias("text_hash"))
    return rows.mapInArrow(
        sign, "doc_id long, n_shingles long, node long, text_hash long, " + ", ".join(
            f"{c} long" for c in names))


def _left_out(errors: int) -> list[tuple[int, ...]]:
    """The places of a chunk that its keys leave out, in the order of the keys."""
    return list(combinations(range(CHUNK), errors))


def index_keys(nodes: DataFrame, chunks: int, errors: int = 1, only: range | None = None,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, node, ...): the signature's chunks with each ``errors`` components left out.

    A key packs the bytes of the other components and, in its remainder by the
    number of keys, its chunk and the places left out, so equal keys mean equal
    components. Signatures that differ in up to ``(errors + 1) * chunks - 1``
    components share a key. ``only`` lists the keys of those chunks alone; ``carry``
    names longs that go with the node.
    """
    only = range(chunks) if only is None else only
    names, chunk, left_out = _sign_columns(chunks), CHUNK, _left_out(errors)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(left_out)
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            n = batch.num_rows
            longs = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            parts = np.ascontiguousarray(longs).view(np.uint8)
            parts = parts.reshape(n, chunks, chunk)[:, only.start:only.stop].astype(np.int64)
            keys = np.empty((n, len(only), many), dtype=np.int64)
            for at, out in enumerate(left_out):
                packed = np.zeros((n, len(only)), dtype=np.int64)
                for i in range(chunk):
                    if i not in out:
                        packed = packed * 256 + parts[:, :, i]
                place = np.arange(only.start, only.stop, dtype=np.int64) * many + at
                keys[:, :, at] = packed * (chunks * many) + place
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)),
                 *[pa.array(np.repeat(batch.column(c).to_numpy(), len(only) * many))
                   for c in ("node", *carry)]], names=["key", "node", *carry])

    return nodes.select("node", *carry, *names).mapInArrow(
        expand, ", ".join(f"{c} long" for c in ("key", "node", *carry)))


def _long(bits: int) -> Column:
    """64 bits as a long."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _components_that_differ(x: Column, y: Column) -> Column:
    """Bytes that differ between two longs.

    127 more in the lower seven bits of a byte set its eighth where any of them is set. The
    highest byte gets 255, as 127 could leave the long; there the eighth bit is clear instead.
    Few operations: an expression is written out wherever it is used.
    """
    bits = x.bitwiseXOR(y)
    carried = bits.bitwiseAND(_long(0x7F7F7F7F7F7F7F7F)) + _long(0xFF7F7F7F7F7F7F7F)
    return F.bit_count(carried.bitwiseXOR(_long(1 << 63)).bitwiseOR(bits).bitwiseAND(
        _long(0x8080808080808080)))


def _distance(names: list[str]) -> Column:
    return sum((_components_that_differ(F.col(f"_a{c}"), F.col(f"_b{c}")) for c in names), F.lit(0))


def _can_reach(percent: int) -> Column:
    """Whether sizes and parities of two sets allow ``percent`` of similarity; exact.

    With d shingles that only one of them has, and n in both sets' sizes together, they
    share (n - d) / 2 of (n + d) / 2.
    """
    odd = sum((F.bit_count(F.col(f"_a{c}").bitwiseXOR(F.col(f"_b{c}"))) for c in PARITY_COLUMNS),
              F.lit(0))
    one, two = F.col("_an_shingles"), F.col("_bn_shingles")
    most = (100 - percent) * (one + two)
    return (most >= (100 + percent) * F.abs(one - two)) & (most >= (100 + percent) * odd.cast("long"))


def _close(chunks: int, far: int, percent: int) -> Column:
    """Whether a joined pair passes the distance of the signatures and the exact bound."""
    return _can_reach(percent) & (_distance(_sign_columns(chunks)) <= far)


def _sided(signs: DataFrame, node: str, side: str) -> DataFrame:
    """``signs`` of one side of a pair, with the columns named for it."""
    return signs.select(F.col("node").alias(node), *[
        F.col(c).alias(f"_{side}{c}") for c in signs.columns if c != "node"])


def _near(pairs: DataFrame, signs: DataFrame, close: Column) -> DataFrame:
    """Pairs (a, b) that pass ``close``; a condition of the join, so no other pair leaves it.

    Signatures are wide, so they are shuffled and never sent through the driver.
    """
    left, right = _sided(signs, "a", "a").hint("merge"), _sided(signs, "_node", "b").hint("merge")
    return pairs.join(left, "a").join(right, (F.col("b") == F.col("_node")) & close).select("a", "b")


def _sifted(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that the exact bound allows with FINE parities; ``texts`` are (node, text).

    Of many pairs just below the similarity few are left, and a pair takes two short rows here
    instead of two texts.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole, 1)):
            hashes, first = words_of(batch.column(1), BLACK)
            sets = [shingles(hashes[first[i]:first[i + 1]], width) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([parities(s, FINE).tobytes() for s in sets], pa.binary())],
                names=["node", "n", "odd"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_numpy() for c in ("na", "nb"))
            x, y = (text_bytes(batch.column(c))[0].view(np.uint64).reshape(-1, FINE // 64)
                    for c in ("odda", "oddb"))
            apart = np.maximum(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), abs(one - two))
            keep = (100 - percent) * (one + two) >= (100 + percent) * apart
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    fine = staged(texts.select("node", "text").mapInArrow(sign, "node long, n long, odd binary"), "fine")
    met = pairs.select("a", "b")
    for side in "ab":
        met = met.join(fine.toDF(side, f"n{side}", f"odd{side}"), side)
    rest = staged(met.mapInArrow(possible, "a long, b long"), "sifted")
    discard(fine)
    return rest


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str,
             width: int, percent: int, sift: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets reach the similarity, from their texts.

    A node's text is that of one of its rows, named by its id and the hash of its text;
    rows that repeat both combine to one before they are shuffled. ``sift``: few of the
    pairs are likely to.
    """
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = staged(needed.join(reps, "node").select(
        "node", F.col("rep").alias("_rep"), F.col("rep_text").alias("_hash")), "needed")
    source = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"),
                         F.xxhash64(F.col(text)).alias("_of"))
    texts = staged(source.join(sized(needed, needed.count()), (F.col("_of") == F.col("_hash"))
                               & F.col("_id").eqNullSafe(F.col("_rep")))
                   .groupBy("node").agg(F.first("text").alias("text")), "texts")
    sifted = [_sifted(pairs, texts, width, percent)] if sift else []
    pairs = sifted[0] if sift else pairs

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole, 2)):
            one, first = words_of(batch.column(2), BLACK)
            two, second = words_of(batch.column(3), BLACK)
            partners = batch.column(1).to_numpy()
            keep = []
            for i in range(batch.num_rows):
                x = shingles(one[first[i]:first[i + 1]], width)
                if i == 0 or partners[i] != partners[i - 1]:
                    y = shingles(two[second[i]:second[i + 1]], width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = (pairs.select("a", "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
              .select("a", "b", "text_a", "text_b"))
    links = staged(joined.mapInArrow(similar, "a long, b long"), "confirmed")
    discard(needed, texts, *sifted)
    return links


@contextmanager
def _frugal(spark: SparkSession) -> Iterator[None]:
    """Around queries that are staged: shuffle files go with the query that wrote them, and
    Python gets a thousand rows at a time, as a batch of pairs holds two texts a row.

    A session of its own for these queries would leave the caller's settings alone, but
    costs the driver memory.
    """
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _keyed(nodes: DataFrame, roots: DataFrame | None, chunks: int, only: range,
           many: int) -> DataFrame:
    """(key, node, root) of some chunks; a node that is linked with nothing is its own root.

    Every task lists about TASK_KEYS keys of the ``many`` nodes.
    """
    nodes = nodes.select("node", *_sign_columns(chunks))
    rooted = (nodes.withColumn("root", F.col("node")) if roots is None
              else nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    tasks = -(-many * len(only) * len(_left_out(ERRORS)) // TASK_KEYS)
    return index_keys(rooted.repartition(max(1, tasks), "node"), chunks, ERRORS, only, ("root",))


def _drawn(turn: int) -> Column:
    """A node, as the draw of the hubs of a ``turn`` orders them; twice gives the node.

    Nodes are hashes, so the least one is a draw, and one on which keys agree; another
    turn takes bits of the nodes the other way round, which is another draw.
    """
    return F.col("node").bitwiseXOR(F.lit((turn * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF).cast("long"))


def _with_hubs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a node of each component of a key with the key's hub.

    ``members`` are (key, node, root, hub), with the hub of that turn. The least drawn
    node stands for a component.
    """
    ones = members.groupBy("key", "hub", "root").agg(F.min(_drawn(turn)).alias("node"))
    return ones.select(_drawn(turn).alias("node"), "hub").filter("node != hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _meetings(nodes: DataFrame, roots: DataFrame | None, chunks: int, only: range, many: int
              ) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowds) of the keys of some chunks that hold several components.

    ``pairs`` (a, b) are all those of keys with up to three nodes, and those with the hub
    of a larger one, its least node; ``crowds`` are (key, node, root, hub) of the larger ones.
    """
    keys = _keyed(nodes, roots, chunks, only, many)
    counted = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"),
        F.bit_xor("node").alias("x"), F.min("root").alias("low"), F.max("root").alias("high")
        ).filter("low != high")

    def pair(a: Column, b: Column, n: Column | None = None) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), (F.lit(0).cast("long") if n is None else n
                                                     ).alias("n"))

    lo, hi = F.col("lo"), F.col("hi")
    middle = F.col("x").bitwiseXOR(lo).bitwiseXOR(hi)  # the third of three
    found = staged(counted.select(F.explode(
        F.when(F.col("n") == 2, F.array(pair(lo, hi)))
        .when(F.col("n") == 3, F.array(pair(lo, middle), pair(middle, hi), pair(lo, hi)))
        .otherwise(F.array(pair(F.col("key"), lo, F.col("n"))))).alias("p"))
        .select("p.*").distinct(), "found")
    more = found.filter("n > 0").select(F.col("a").alias("key"), F.col("b").alias("hub"))
    crowds = staged(keys.join(sized(more, more.count()), "key"), "crowds")
    pairs = staged(found.filter("n = 0").select("a", "b").union(_with_hubs(crowds, 0)).distinct(),
                   "meetings")
    discard(found)
    return pairs, crowds


def _again(mixed: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """The keys that still hold several components, after some have joined, with a turn's hubs."""
    placed = mixed.select("key", "node").join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"))
    spread = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                       F.min(_drawn(turn)).alias("node"))
    hubs = spread.filter("low != high").select("key", _drawn(turn).alias("hub"))
    return placed.join(hubs, "key").select("key", "node", "root", "hub")


def _key_place(names: list[str], columns: list[str]) -> list[Column]:
    """(chunk, out, one, two) of a key and a signature, in ``columns``: the key's chunk, which two
    places it leaves out, and the signature's components there."""
    left_out = _left_out(ERRORS)
    place = F.col("key") % (len(left_out) * len(names))
    chunk, out = F.floor(place / len(left_out)).cast("int"), (place % len(left_out)).cast("int")
    own = F.get(F.array(*[F.col(c) for c in columns]), chunk)
    return [chunk, out, *[own.bitwiseAND(F.get(F.array(*[
        _long(255 << 8 * places[i]) for places in left_out]), out)) for i in range(ERRORS)]]


def _first_key(names: list[str], placed: bool = False) -> Column:
    """Whether the key of a joined pair is the first that the two signatures share.

    That is in the first chunk with at most two differences: the first key there
    that leaves all of them out. ``placed``: what depends on one side is there already, in
    ``_chunk``, ``_out``, and ``_one`` and ``_two`` of each side.
    """
    chunk, out, *mine = _key_place(names, [f"_a{c}" for c in names])
    their = _key_place(names, [f"_b{c}" for c in names])[2:]
    if placed:
        chunk, out, *mine = map(F.col, ("_chunk", "_out", "_aone", "_atwo"))
        their = [F.col("_bone"), F.col("_btwo")]
    # As the pair shares the key, all differences of the chunk are in the two places. The first
    # key leaves out the first two places, the next ones the first and another. So it is the
    # first one, or the second place differs, and the first one does or is the chunk's first.
    first = (out == 0) | ((mine[1] != their[1]) & ((out < CHUNK - 1) | (mine[0] != their[0])))
    earlier = [(F.lit(i) >= chunk)
               | (_components_that_differ(F.col(f"_a{c}"), F.col(f"_b{c}")) > ERRORS)
               for i, c in enumerate(names[:-1])]
    return reduce(Column.__and__, earlier, first)


def _apart(mixed: DataFrame, signs: DataFrame, chunks: int, close: Column) -> DataFrame:
    """(a, b): nodes of different components that share a key and pass ``close``.

    One side leaves out the largest component of the key; a pair counts under its
    first key alone. All pairs of a key are looked at, so the condition has to be machine
    code: Java never compiles methods of more than 8,000 bytes, and a null check for each
    operation makes it one. So no column may be null here.
    """
    sizes = mixed.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    wide = mixed.join(largest, "key").join(signs.hint("merge"), "node")
    columns, names = [c for c in signs.columns if c != "node"], _sign_columns(chunks)

    def known(name: str, value: Column) -> Column:
        return F.coalesce(value, F.lit(0)).alias(name)

    def sided(side: str) -> list[Column]:
        *at, one, two = _key_place(names, names)
        return [known(side, F.col("node")), known(f"r{side}", F.col("root")),
                *[known(f"_{side}{c}", F.col(c)) for c in columns],
                known(f"_{side}one", one), known(f"_{side}two", two),
                *[known(name, place) for name, place in zip(("_chunk", "_out"), at) if side == "a"]]

    left = wide.filter("root != main").select("key", *sided("a"))
    right = wide.select(F.col("key").alias("_key"), *sided("b"), F.coalesce(
        F.col("root") == F.col("main"), F.lit(False)).alias("in_main"))
    meet = ((F.col("key") == F.col("_key")) & (F.col("ra") != F.col("rb"))
            & (F.col("in_main") | (F.col("a") < F.col("b")))
            & _first_key(names, placed=True) & close)
    return left.join(right, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias(
        "b"))


def linked_sets(signed: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int,
                percent: int, chunks: int, far: int) -> DataFrame:
    """(node, root) of all nodes that are linked with a node of another set."""
    names = _sign_columns(chunks)
    spark = signed.sparkSession
    # A row of the set: with the least id, if any has one.
    row = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    nodes = staged(signed.filter(F.col("node").isNotNull()).groupBy("node").agg(
        row["doc_id"].alias("rep"), row["text_hash"].alias("rep_text"),
        *[F.min(c).alias(c) for c in ("n_shingles", *names, *PARITY_COLUMNS)]), "nodes")
    signs, reps = nodes.drop("rep", "rep_text"), nodes.select("node", "rep", "rep_text")
    close = _close(chunks, far, percent)
    tested = staged(spark.createDataFrame([], "a long, b long"), "tested")
    many, roots = nodes.count(), None

    def test(pairs: DataFrame, passed: bool = False) -> int:
        """Confirm the pairs that were not tested yet; the number of links among them.

        ``passed``: they are known to pass ``close``, and may be many.
        """
        nonlocal tested, roots
        fresh = pairs.join(tested, ["a", "b"], "left_anti")
        fresh = staged(fresh if passed else _near(fresh, signs, close), "pairs")
        more = _confirm(fresh, reps, docs, doc_id, text, width, percent, passed)
        gained = more.count()
        tested = tested.union(fresh)
        if roots is None:
            roots = staged(components(more), "roots")
        elif gained:
            roots = staged(joined(roots, more), "roots")
        return gained

    crowded = []
    for only in [s for s in STEPS if s.start < chunks]:
        met, crowds = _meetings(nodes, roots, chunks, only, many)
        test(met)
        discard(met)
        crowded.append(crowds)
        forget(spark)
    turn = 1
    mixed = staged(_again(reduce(DataFrame.union, crowded), roots, turn), "mixed")
    discard(*crowded)
    forget(spark)
    while not mixed.isEmpty():  # another hub for every key that holds several components
        offered = staged(_with_hubs(mixed, turn), "offered")
        gained, asked = test(offered), offered.count()
        discard(offered)
        if gained:
            turn += 1
            mixed = staged(_again(mixed, roots, turn), "mixed")
        if gained < WORTHWHILE * asked or not gained:
            break
    forget(spark)
    # What hubs could not settle: nodes of a key in different components, pair by pair.
    test(_apart(mixed, signs, chunks, close), passed=True)
    discard(nodes, mixed)
    return roots


def _judged(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, chunks: int,
            far: int) -> tuple[DataFrame, DataFrame]:
    """(signed, named): ``signatures`` of all rows, and (node, root, component_id) of all sets."""
    with _frugal(docs.sparkSession):
        signed = staged(signatures(docs, doc_id, text, width, chunks), "signed")
        roots = linked_sets(signed, docs, doc_id, text, width, percent, chunks, far)
    classes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("rep"))
    placed = classes.join(roots, "node", "left").select(
        "node", "rep", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return signed, staged(placed.join(least, "root").select("node", "root", "component_id"), "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80, chunks: int = CHUNKS, far: int = FAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id that is reachable over links, itself
    included; ``kept`` marks the documents that are their component's least.
    """
    signed, named = _judged(docs, doc_id, text, width, percent, chunks, far)
    return signed.select("doc_id", "n_shingles", "node").join(
        named.drop("root"), "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(
            F.col("component_id")).alias("component_id")).select(
        "*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                percent: int = 80, unnamed_stay: bool = True) -> DataFrame:
    """The documents that stand for their group, with all their columns.

    One row of each component stays: of those with the least id, the first by
    text. An id with unlinked texts stays once for each of their components, a
    word-less text once per id. ``unnamed_stay`` keeps all rows without an id, as
    they can't be named; else they are judged like the others, behind every row
    with an id, and only their word-less texts, which link with nothing, all stay.

    A row is found again by its id and a 64-bit hash of its text.
    """
    signed, named = _judged(docs, doc_id, text, width, percent, CHUNKS, FAR)
    judged = signed.select("doc_id", "text_hash", "node").join(
        named.select("node", "root", "component_id"), "node", "left")
    # The least id of a component, null only where it has no other.
    least = judged.filter(F.col("node").isNotNull()
                          & F.col("doc_id").eqNullSafe(F.col("component_id")))
    empty = judged.filter(F.col("node").isNull() & F.col("doc_id").isNotNull())
    if unnamed_stay:
        least = least.filter(F.col("doc_id").isNotNull())
    texts = (least.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
             .union(empty.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).select(
                 F.lit(None).cast("long"), "doc_id", "text_hash", "n")))
    group = [F.col("root"), *[F.when(F.col("root").isNull(), F.col(c)) for c in ("doc_id", "text_hash")]]
    texts = texts.select(*[g.alias(f"_g{i}") for i, g in enumerate(group)],
                         F.col("doc_id").alias("_of"), F.col("text_hash").alias("_its"), "n")
    keys = ["_g0", "_g1", "_g2"]
    sizes = texts.groupBy(*keys).agg(F.sum("n").alias("_rows"))
    match = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, ("_h0", "_h1", "_h2"))]
    found = staged(texts.join(sizes.toDF("_h0", "_h1", "_h2", "_rows"), match)
                   .select(*keys, "_of", "_its", "_rows"), "standing")

    whole = docs.select(F.col(doc_id).cast("long").alias("_id"),
                        F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("_text"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    here = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_its"))
    one = whole.join(found.filter("_rows = 1"), here, "left_semi").select("row")
    # Rows that repeat an id: an aggregate, which combines before its shuffle.
    first = whole.join(found.filter("_rows > 1"), here).groupBy(*keys).agg(
        F.min_by("row", F.struct(F.col("_text").isNotNull(), "_text")).alias("row")).select("row")
    rest = F.col("_id").isNull()
    if not unnamed_stay:
        bare = signed.filter("doc_id is null and node is null").select(
            F.col("text_hash").alias("_its")).distinct()
        nameless = whole.filter(rest).join(bare, F.col("_hash") == F.col("_its"), "left_semi")
    else:
        nameless = whole.filter(rest)
    return one.union(first).union(nameless.select("row")).select("row.*")
