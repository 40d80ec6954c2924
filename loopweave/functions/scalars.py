"""Column expressions for cleaning raw feed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or_null(text: Column, kind: str = "double") -> Column:
    return text.try_cast(kind)


def number_or_zero(text: Column, kind: str = "double") -> Column:
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def blank_as_zero(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), "0").otherwise(text)


# Fixed pattern: the number that ends a postmile such as R12.5.
TRAILING_NUMBER = r"(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))$"


def postmile(text: Column) -> Column:
    """Number left after dropping leading route letters; 0 when there is none."""
    tail = F.regexp_extract(text, TRAILING_NUMBER, 1)
    return F.coalesce(F.nullif(tail, F.lit("")).try_cast("double"), F.lit(0.0))


def date_in_path(path: Column) -> Column:
    """Last yyyy_mm_dd in the file name at the end of a path; folders don't count."""
    found = F.regexp_extract(path, r"^(?:.*/)?[^/]*([0-9]{4}_[0-9]{2}_[0-9]{2})[^/]*$", 1)
    return F.to_date(F.nullif(found, F.lit("")), "yyyy_MM_dd")


# Fixed value: the one description that has a code although its text shows none.
UNCODED_CLOSURE = "CLOSURE of a Road"


def incident_code(description: Column) -> Column:
    parts = F.split(description, "-", 2)
    return (F.when(F.size(parts) == 2, F.trim(parts[0]))
            .when(F.trim(description) == UNCODED_CLOSURE, "1"))


def incident_text(description: Column) -> Column:
    return F.trim(F.element_at(F.split(description, "-", 2), -1))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, sign: Column) -> Column:
    value = degrees + minutes / F.lit(60.0) + seconds / F.lit(3600.0)
    return F.when(sign == "-", -value).otherwise(value)


def id_without_prefix(text: Column, prefix: int = 2) -> Column:
    return F.substring(text, prefix + 1, 1000).try_cast("int")


def direction_code(direction: Column, codes: dict[str, int], otherwise: int = -1) -> Column:
    expression = F.lit(otherwise)
    for name, code in codes.items():
        expression = F.when(direction == name, code).otherwise(expression)
    return expression


def yes_no(present: Column) -> Column:
    return F.when(present, "T").otherwise("F")


def point_text(latitude: Column, longitude: Column) -> Column:
    """``POINT(lon lat)`` with six decimals."""
    return F.format_string("POINT(%.6f %.6f)", longitude, latitude)


def key_text(*columns: Column) -> Column:
    return F.concat_ws("_", *[c.cast("string") for c in columns])


def key_parts(text: Column, kinds: list[str]) -> list[Column]:
    parts = F.split(text, "_")
    return [parts[i].cast(kind) for i, kind in enumerate(kinds)]
