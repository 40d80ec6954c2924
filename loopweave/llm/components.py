"""Connected components of a link table, by least neighbours and pointer jumping.

Every step is an aggregate by node (which combines before its shuffle, so a hub
with very many links is no hot task) or an equi-join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.session import discard, staged


def _followed(parents: DataFrame) -> DataFrame:
    """(node, root, moved) after as many more steps as each root lies away."""
    further = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return parents.join(further, "root").select(
        "node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))


def _jump_to_roots(parents: DataFrame) -> DataFrame:
    """Follow (node, root) to its ends; the followed length grows fourfold each time."""
    staging = None
    while True:
        jumped = staged(_followed(_followed(parents).drop("moved")), "parents")
        settled = jumped.filter("moved").isEmpty()
        if staging is not None:
            discard(staging)
        parents = jumped.drop("moved")
        if settled:
            return parents
        staging = jumped


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every linked node with the least node of its component.

    Links are pairs of comparable ids, in any order, repeated or not; a link of
    a node to itself or to null adds nothing, and an empty table gives an empty
    one. Each round points every node at its least neighbour, follows the
    pointers to the local minima, and goes on with the links between those; that
    at least halves the nodes.
    """
    edges = staged(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))), "edges")
    whole = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        roots = _jump_to_roots(least.select("node", F.least("node", "root").alias("root")))
        if whole is None:
            whole = roots
        else:
            known = roots.select(F.col("node").alias("root"), F.col("root").alias("lower"))
            whole = whole.join(known, "root", "left").select(
                "node", F.coalesce("lower", "root").alias("root"))
        one = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = staged(edges.join(one, "a").join(two, "b").filter("ra != rb").select(
            F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        discard(edges)
        edges = rest
        if edges.isEmpty():
            return whole


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots``, (node, root) as ``components`` gives them, after further links (a, b).

    Only the links between different roots are worked on.
    """
    named = links.select("a", "b")
    for side in "ab":
        place = roots.select(F.col("node").alias(side), F.col("root").alias("_root"))
        named = named.join(place, side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    lower = staged(components(named.distinct()), "lower")
    moved = lower.select(F.col("node").alias("root"), F.col("root").alias("lower"))
    return roots.join(moved, "root", "left").select("node", F.coalesce("lower", "root").alias("root")
        ).union(lower.join(roots, "node", "left_anti").select("node", "root"))
