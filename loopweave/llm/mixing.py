"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

A source's target asks each of its documents for ``target / source size`` copies.
The whole part is certain; the fraction is a probability p, rounded to 0 or 1 so
that the source's words come out right: two documents with fractional p meet, and
words move from one to the other, in one of two directions drawn so that no
document's expectation changes, until one of the two p is 0 or 1. The other one
goes on to the next meeting. Every meeting keeps the source's words as they are,
so the mix misses a target by less than one document.

Large documents go first, the largest ones leading: each meets all smaller ones of
its source at once, which share the words that move, so that the last document
left over is a small one. A document is large if it holds 1/LARGE of its source
or more, so a source has at most LARGE of them.

Meetings run in a reduction tree: documents are dealt by hash to blocks of about
``BLOCK``, each block folds to at most one unsettled document, and these are dealt
to the blocks of the next level, until one document of each source is left, which
is rounded by a draw. A hot source is merely more blocks. Draws are hashes of ids,
so reruns agree.

Defined cases: a null or blank text has size 0 and gives no words; a null source
is a source of its own, the last one; rows that repeat, in whole or in their id
alone, are documents of their own, as are those without an id; an empty table gives an empty mix; a source without words has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.llm.sizes import sized
from loopweave.operators.dimensions import ordered_ids
from loopweave.session import discard, staged

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
LARGE = 500
BLACK_WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """(doc_id, copy, source, size): ``copy`` numbers rows that agree in the other three.

    So a unit of a source is named by its id, size and copy together.
    """
    size = F.when(F.col(text).isNull(), 0).otherwise(
        F.regexp_count(text, F.lit(BLACK_WORD))).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(source).cast("string").alias("source"), size.alias("size"))
    return (rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"))


def targets(units: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, place, source_size, target): weights go round the sources in code point order.

    A target is ``min(most * size, level * weight)``. The level is raised until
    the targets add up: each round shares what the full sources leave over.
    """
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = staged(ordered_ids(sums, ["source"], out="place", nulls_last=True), "sources")
    place = F.pmod(F.col("place") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    sources = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while whole:
        # One row comes back: what is capped, and the weight that shares the rest.
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        n, held, free = sources.agg(
            F.count(F.when(capped, 1)), F.sum(F.when(capped, F.col("cap"))),
            F.sum(F.when(~capped, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (share * whole - (held or 0.0)) / free
    target = F.least("cap", F.col("weight") * F.lit(level))
    return sources.select("source", "place", "source_size", target.alias("target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _meet(one: Column, two: Column, level: int) -> tuple[Column, Column]:
    """New p of two documents after words moved between them."""
    up = F.least((1 - one["p"]) * one["size"], two["p"] * two["size"])  # words from two to one
    down = F.least(one["p"] * one["size"], (1 - two["p"]) * two["size"])
    draw = _draw(*[x[c] for x in (one, two) for c in ("doc_id", "size", "copy")], F.lit(level))
    upward = draw * (up + down) < down
    fills = (1 - one["p"]) * one["size"] <= two["p"] * two["size"]  # one reaches 1 first
    empties = one["p"] * one["size"] <= (1 - two["p"]) * two["size"]  # one reaches 0 first
    p_one = (F.when(upward & fills, 1.0).when(upward, one["p"] + up / one["size"])
             .when(empties, 0.0).otherwise(one["p"] - down / one["size"]))
    p_two = (F.when(upward & ~fills, 0.0).when(upward, two["p"] - up / two["size"])
             .when(~empties, 1.0).otherwise(two["p"] + down / two["size"]))
    return p_one, p_two


def _unit(x: Column, p: Column) -> Column:
    return F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"),
                    x["size"].alias("size"), p.alias("p"))


def _settled(p: Column) -> Column:
    return (p <= 0.0) | (p >= 1.0)


def _fold(block: Column, level: int) -> Column:
    """struct(left, done): the meetings of a block, one after another."""
    unit = "struct<h:bigint,doc_id:bigint,copy:bigint,size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(unit).alias("left"), F.array().cast(f"array<{unit}>").alias(
        "done"))

    def meeting(state: Column, new: Column) -> Column:
        old = state["left"]
        p_old, p_new = _meet(old, new, level)
        # Bind the results once: array elements are computed, then reused by name.
        both = F.array(_unit(old, p_old), _unit(new, p_new))
        after = F.transform(F.array(both), lambda pair: F.struct(
            F.filter(pair, lambda u: ~_settled(u["p"])).alias("open"),
            F.filter(pair, lambda u: _settled(u["p"])).alias("shut")))[0]
        met = F.transform(F.array(after), lambda a: F.struct(
            F.get(a["open"], F.lit(0)).alias("left"),
            F.concat(state["done"], a["shut"]).alias("done")))[0]
        return F.when(old.isNull(), F.struct(new.alias("left"), state["done"].alias("done"))
                      ).otherwise(met)

    return F.aggregate(block, start, meeting)


def _settle_large(units: DataFrame) -> DataFrame:
    """(place, f, done, open): the large documents of each source, and p of all others.

    ``units`` are large ones with the same p for a source. Each goes to 1 with
    probability p, else to 0; what that gives or takes changes the p of all smaller
    documents alike. One that the smaller ones can't make up for stays open.
    """
    unit = "struct<doc_id:bigint,copy:bigint,size:bigint,p:double>"
    start = F.struct(F.col("p").alias("f"), F.col("source_size").alias("rest"),
                     F.array().cast(f"array<{unit}>").alias("done"),
                     F.array().cast(f"array<{unit}>").alias("open"))

    def step(state: Column, x: Column) -> Column:
        f, rest = state["f"], state["rest"] - x["size"]
        share = x["size"] / F.greatest(rest, F.lit(1).cast("long"))
        fits = (rest > 0) & (f - (1 - f) * share >= 0) & (f + f * share <= 1)
        up = _draw(x["doc_id"], x["size"], x["copy"], F.lit(-1)) < f

        def one(p: Column) -> Column:
            return F.struct(x["doc_id"].alias("doc_id"), x["copy"].alias("copy"),
                            x["size"].alias("size"), p.alias("p"))

        return F.when(fits, F.struct(
            F.when(up, f - (1 - f) * share).otherwise(f + f * share).alias("f"), rest.alias("rest"),
            F.concat(state["done"], F.array(one(F.when(up, 1.0).otherwise(0.0)))).alias("done"),
            state["open"].alias("open"))).otherwise(F.struct(
                f.alias("f"), rest.alias("rest"), state["done"].alias("done"),
                F.concat(state["open"], F.array(one(f))).alias("open")))

    ordered = F.array_sort(F.collect_list(F.struct(
        (-F.col("size")).alias("_o"), F.xxhash64("doc_id", "size", "copy").alias("_h"), "doc_id",
        "copy", "size")))
    return (units.groupBy("place", "source_size", "p").agg(ordered.alias("units"))
            .select("place", F.aggregate("units", start, step).alias("x"))
            .select("place", "x.f", "x.done", "x.open"))


def rounded(units: DataFrame) -> DataFrame:
    """(place, doc_id, size, copy, extra): 0 or 1 for each unit of (place, source_size, ..., p)."""
    large = F.col("size") * LARGE >= F.col("source_size")
    settled = staged(_settle_large(units.filter(large)), "large")
    others = units.filter(~large).join(settled.select("place", "f"), "place", "left").select(
        "place", "doc_id", "copy", "size", F.coalesce("f", "p").alias("p"))
    still = settled.select("place", F.explode("open").alias("u")).select("place", "u.*")
    columns = ["place", "doc_id", "copy", "size", "p"]
    pool = staged(others.select(*columns).union(still.select(*columns)), "pool")
    done = [settled.select("place", F.explode("done").alias("u")).select("place", "u.*"),
            pool.filter(_settled(F.col("p")))]
    return _tree(pool.filter(~_settled(F.col("p"))), [d.select(
        "place", "doc_id", "size", "copy", F.col("p").cast("int").alias("extra")) for d in done])


def _tree(open_units: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Meetings level by level, until one unit of each place is left, which a draw settles."""
    unit = F.struct("h", "doc_id", "copy", "size", "p")
    counts = staged(open_units.groupBy("place").agg(F.count("*").alias("n")), "counts")
    blocks = counts.agg(F.max("n")).first()[0] or 0
    level, open_units = 0, open_units.join(counts, "place")
    while blocks:
        level += 1
        # Unsettled documents are at most one for each block of the level before.
        block = F.pmod(F.xxhash64("doc_id", "size", "copy", F.lit(level)),
                       F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / BLOCK ** level)))
        hashed = open_units.withColumn("h", F.xxhash64("doc_id", "size", "copy", F.lit(-level)))
        folded = (hashed.groupBy("place", "n", block.alias("block"))
                  .agg(F.array_sort(F.collect_list(unit)).alias("units"))
                  .select("place", "n", _fold(F.col("units"), level).alias("x"))
                  .select("place", "n", "x.left", "x.done"))
        folded = staged(folded, "rounds")
        done.append(folded.select("place", F.explode("done").alias("u")).select(
            "place", "u.doc_id", "u.size", "u.copy", F.col("u.p").cast("int").alias("extra")))
        open_units = folded.filter(F.col("left").isNotNull()).select("place", "n", "left.*").drop("h")
        if blocks <= 1:
            break
        blocks = math.ceil(blocks / BLOCK)
    draw = _draw(F.col("doc_id"), F.col("size"), F.col("copy"), F.lit(0))
    out = open_units.select("place", "doc_id", "size", "copy",
                            F.when(draw < F.col("p"), 1).otherwise(0).alias("extra"))
    for part in done:
        out = out.union(part)
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST) -> DataFrame:
    """One row per document: doc_id, copy, source, size, source_size, target, copies, taken."""
    units = staged(sizes(docs, doc_id, source, text), "units")
    goals = targets(units, weights, share, most)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    asked = units.join(goals, units["source"].eqNullSafe(goals["source"])).select(
        "doc_id", "copy", units["source"], "size", "place", "source_size", "target",
        F.floor(wanted).cast("int").alias("sure"), (wanted - F.floor(wanted)).alias("p"))
    asked = staged(asked, "asked")
    extra = rounded(asked.filter("p > 0 and size > 0").select(
        "place", "source_size", "doc_id", "copy", "size", "p"))
    keys = ["place", "doc_id", "size", "copy"]
    extra = extra.select(*[F.col(k).alias(f"_{k}") for k in keys], "extra")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    copies = F.col("sure") + F.coalesce("extra", F.lit(0))
    discard(units)
    return asked.join(extra, same, "left").select(
        "doc_id", "copy", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
          text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
          most: float = MOST) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Rows that repeat (same id, source and size) are taken together as often as
    their copies add up to, spread over them as evenly as it goes.
    """
    plan = mix(docs, doc_id, source, text, weights, share, most)
    size = F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(
        text, F.lit(BLACK_WORD))).cast("long")
    keys = ["_id", "_source", "_size"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(doc_id).cast("long").alias("_id"),
                       F.col(source).cast("string").alias("_source"), size.alias("_size"))
    total = plan.groupBy(*[F.col(c).alias(f"{k}2") for c, k in zip(
        ("doc_id", "source", "size"), keys)]).agg(F.sum("copies").alias("_copies"),
                                                  F.count("*").alias("_n"))
    # A hash of the keys, nulls and all, partitions the join.
    rows = rows.withColumn("_key", F.xxhash64(*keys))
    total = staged(total.withColumn("_key2", F.xxhash64(*[f"{k}2" for k in keys])).filter(
        "_copies > 0"), "copies")
    same = F.col("_key") == F.col("_key2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}2"))
    alone = rows.join(total.filter("_n = 1"), same).select("row", F.col("_copies").alias("_times"))
    repeated = total.filter("_n > 1")
    n = repeated.count()
    if n:
        alone = alone.unionByName(_shared(rows.join(sized(repeated, n), same), text))
    times = F.array_repeat(F.lit(0), F.col("_times").cast("int"))
    return alone.select("row", F.explode(times)).select("row.*")


def _shared(rows: DataFrame, text: str) -> DataFrame:
    """(row, _times) of rows that repeat: their copies, spread evenly in text order.

    Rows are numbered in ranges of (key, text, place in the input), so one row that
    makes up a third of the table spreads over many tasks.
    """
    numbered = staged(ordered_ids(rows.select(
        "row", "_key", "_copies", "_n", F.col(f"row.`{text}`").alias("_text"),
        F.monotonically_increasing_id().alias("_in")), ["_key", "_text", "_in"], "_number"), "copies")
    first = numbered.groupBy("_key").agg(F.min("_number").alias("_first"))
    turn = F.col("_number") - F.col("_first") + 1
    return numbered.join(first, "_key").select("row", (
        F.expr("_copies div _n") + (turn <= F.col("_copies") % F.col("_n")).cast("long")).alias(
            "_times"))
