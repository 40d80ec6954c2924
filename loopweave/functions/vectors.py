"""Expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(array: Column) -> Column:
    return array.cast("array<double>")


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def mean(array: Column) -> Column:
    return total(array) / F.size(array)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def mse(a: Column, b: Column) -> Column:
    return squared_distance(a, b) / F.size(a)


def nan_as_zero(a: Column) -> Column:
    return F.transform(a, lambda x: F.nanvl(x, F.lit(0.0)))
