"""Registry that pairs each query with the SQL that must give the same rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loopweave.catalog.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Raw files by (writer, data), if they are kept between queries: (path, seconds to write).
KEPT: dict[tuple[str, str], tuple[str, float]] = {}


class Fixtures:
    """Whether the raw files that queries read are kept; benchmarks keep them."""

    keep = False


def fixture(write: Callable[[Tables], str]) -> Callable[[Tables], str]:
    """A function that writes raw files from the tables and returns their path."""

    @wraps(write)
    def path(tables: Tables) -> str:
        if not Fixtures.keep:
            return write(tables)
        key = write.__name__, tables.sf_dir
        if key not in KEPT:
            begin = time.perf_counter()
            made = write(tables)
            KEPT[key] = made, round(time.perf_counter() - begin, 4)
        return KEPT[key][0]

    return path


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the fixture views by name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
