"""Validation with an explicit reject output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.schemas import DIRECTIONS, LANE_TYPES


@dataclass(frozen=True)
class Rule:
    """A named condition; rows where it is false or null are rejected."""

    name: str
    passes: Column
    fields: tuple[str, ...]
    kind: str = "expression"

    @property
    def message(self) -> str:
        return f"{self.name} failed on {', '.join(self.fields)}"


def valid_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that pass all rules; a plain filter, so it reaches the scan."""
    passes = F.lit(True)
    for rule in rules:
        passes = passes & rule.passes
    return df.filter(passes)


def failed_rules(rules: list[Rule]) -> Column:
    """Names of the rules a row breaks; empty for a valid row."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(r.passes, F.lit(False)), F.lit(r.name)) for r in rules]))


def screened(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``failed``, the names of the broken rules).

    Every row is in exactly one of the two.
    """
    marked = df.withColumn("failed", failed_rules(rules))
    return valid_rows(df, rules), marked.filter(F.size("failed") > 0)


def reject_records(df: DataFrame, rules: list[Rule], record: str, component: str) -> DataFrame:
    """One record per rejected row and failed rule."""
    def described(i: int, rule: Rule) -> Column:
        values = F.map_from_arrays(
            F.array(*[F.lit(f) for f in rule.fields]),
            F.array(*[F.col(f).cast("string") for f in rule.fields]))
        return F.struct(
            F.lit(rule.message).alias("message"), F.lit(rule.name).alias("rule_name"),
            F.lit(rule.kind).alias("rule_type"), F.lit(f"{component}/{i}").alias("rule_path"),
            F.array(*[F.lit(f) for f in rule.fields]).alias("fields"), values.alias("values"))

    failures = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule.passes, F.lit(False)), described(i, rule))
        for i, rule in enumerate(rules)]))
    return (df.select(F.col(record).alias("record_no"), F.explode(failures).alias("_f"))
            .select("record_no", "_f.*", F.current_timestamp().alias("validation_date"),
                    F.lit(component).alias("component")))


def validate(df: DataFrame, rules: list[Rule], record: str,
             component: str = "validator") -> tuple[DataFrame, DataFrame]:
    """(valid rows, reject records)."""
    return valid_rows(df, rules), reject_records(df, rules, record, component)


def split_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) rows of any condition; null counts as refused."""
    return df.filter(accepted(condition)), df.filter(~accepted(condition))


def accepted(condition: Column) -> Column:
    """The decision of ``split_rows`` as a column, for one scan."""
    return F.coalesce(condition, F.lit(False))


def not_null(*columns: str) -> list[Rule]:
    return [Rule(f"{c} not null", F.col(c).isNotNull(), (c,), "nonempty") for c in columns]


def within_range(column: str, low, high) -> Rule:
    return Rule(f"{column} in [{low}, {high}]", F.col(column).between(low, high), (column,),
                "interval")


def one_of(column: str, values: list, ignore_case: bool = False) -> Rule:
    tested = F.upper(column) if ignore_case else F.col(column)
    return Rule(f"{column} in list", tested.isin(*values), (column,), "enum")


def is_integer(column: str) -> Rule:
    return Rule(f"{column} is integer", F.col(column).try_cast("int").isNotNull(), (column,),
                "number")


def observation_rules(occupancy: str = "avg_occupancy", key: str = "id") -> list[Rule]:
    return [within_range(occupancy, 0, 1), *not_null(key)]


def lane_rules() -> list[Rule]:
    return [*not_null("observation_id"),
            Rule("samples >= 1", F.col("samples") >= 1, ("samples",), "comparison"),
            within_range("occupancy", 0, 1), one_of("observed", [0, 1])]


def sensor_rules(lane_type: str = "lane_type", direction: str = "direction",
                 key: str = "station") -> list[Rule]:
    return [one_of(lane_type, LANE_TYPES, True), one_of(direction, DIRECTIONS, True),
            *not_null(key)]


# What a hourly precipitation record must carry.
PRECIPITATION_RECORD = {"record_type": "HPD", "state_code": "04", "element_type": "HPCP"}
PRECIPITATION_UNITS = ["HI", "HT"]


def precipitation_rules() -> list[Rule]:
    exact = [Rule(f"{c} is {v}", F.col(c) == v, (c,), "comparison")
             for c, v in PRECIPITATION_RECORD.items()]
    return [*exact, one_of("element_units", PRECIPITATION_UNITS), is_integer("station_number"),
            is_integer("division"), is_integer("value_count"),
            Rule("month in [1, 12]", F.col("month").try_cast("int").between(1, 12), ("month",),
                 "interval"),
            Rule("year > 1900", F.col("year").try_cast("int") > 1900, ("year",), "comparison"),
            Rule("day in [1, 31]", F.col("day").try_cast("int").between(1, 31), ("day",),
                 "interval")]


def hourly_readings(readings: DataFrame) -> DataFrame:
    """Hours 1..24 without the monthly opening marker and without missing periods."""
    flag = F.coalesce("flag1", F.lit(""))
    opening = (F.col("day") == 1) & (F.col("hour") == 1) & (flag == "g")
    missing = (F.col("amount") == 99999) & flag.isin("[", "]")
    return readings.filter((F.col("hour") <= 24) & ~opening & ~missing)


def daily_totals(readings: DataFrame) -> DataFrame:
    """Hour 25 without empty month ends and without incomplete zero totals."""
    flag = F.coalesce("flag1", F.lit(""))
    empty = (F.col("hour") == 25) & (F.col("amount") == 0) & F.col("flag1").isNull()
    invalid = (F.col("amount") == 0) & flag.isin("I", "P")
    return readings.filter((F.col("hour") > 24) & ~empty & ~invalid)


def hourly_rules() -> list[Rule]:
    return [Rule("id > 0", F.col("id") > 0, ("id",), "comparison"), *daily_rules()]


def daily_rules() -> list[Rule]:
    return [Rule("amount >= 0", F.col("amount") >= 0, ("amount",), "comparison"),
            *not_null("station_id")]


def parity_rule(strict: bool = False) -> Rule:
    """Even freeways run east-west, odd ones north-south.

    The observed rule accepts every direction; ``strict`` applies what it means.
    """
    even, direction = F.col("num") % 2 == 0, F.col("direction")
    if strict:
        passes = F.when(even, direction.isin("E", "W")).otherwise(direction.isin("N", "S"))
    else:
        passes = F.col("num").isNotNull() & direction.isNotNull()
    return Rule("freeway number and direction agree", passes, ("num", "direction"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
