"""Broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 500_000  # rows of a few longs each, so some tens of megabytes


def sized(df: DataFrame, rows: int, most: int = SMALL) -> DataFrame:
    """``df``, marked for broadcast where its counted ``rows`` are few; beyond, joins shuffle."""
    return F.broadcast(df) if rows <= most else df
