"""Exact sets of whole-number ids as bitmaps, which merge and count without the ids.

A set is a few rows: one for each page of 32,768 ids that it touches, with a bitmap of
4 KB. Bitmaps combine on the map side and merge with "or", so sets of days add up to
sets of months, and no group ever holds more than a page.

Defined cases: null ids are in no set; a group without ids has no rows; ids up to zero
lie in pages up to zero, from the page's end down.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 32_768  # fixed by Spark's bitmap functions


def id_sets(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, page, bitmap): the distinct values of each group."""
    id_ = F.col(value).cast("long")
    rows = df.select(*groups, id_.alias("_id")).filter(F.col("_id").isNotNull())
    return rows.groupBy(*groups, F.bitmap_bucket_number("_id").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bitmap"))


def merged(sets: DataFrame, groups: list[str]) -> DataFrame:
    """The union of all sets of each group."""
    return sets.groupBy(*groups, "page").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counts(sets: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n): how many ids each set holds."""
    return sets.groupBy(*groups).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def pages(sets: DataFrame) -> DataFrame:
    """(groups, page, n, ids): the sorted ids, an array of at most a page in each row."""

    @F.arrow_udf("array<bigint>")
    def positions(page: pa.Array, bitmap: pa.Array) -> pa.Array:
        out = []
        for number, bits in zip(page.to_pylist(), bitmap):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8),
                                              bitorder="little"))
            out.append((number - 1) * PAGE + at + 1 if number > 0
                       else np.sort(number * PAGE - at))
        return pa.array(out, pa.list_(pa.int64()))

    rest = [c for c in sets.columns if c not in ("page", "bitmap")]
    return sets.select(*rest, "page", F.bitmap_count("bitmap").alias("n"),
                       positions("page", "bitmap").alias("ids"))
