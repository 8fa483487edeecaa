"""Gates: contradictory, unknown or incomplete data fails the query with a message
that names the rule. They are expressions in the plan, so nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.matching import must


def same_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """``df`` if it has exactly the wanted columns, in any order."""
    lost, extra = sorted(set(wanted) - set(df.columns)), sorted(set(df.columns) - set(wanted))
    if lost or extra:
        raise ValueError(f"columns differ: missing {lost}, undeclared {extra}")
    return df.select(*wanted)


def single_valued(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, value)``; a second value of a key fails."""
    low, high = F.min(value), F.max(value)
    out = df.groupBy(*by).agg(low.alias("low_"), high.alias("high_"))
    return out.select(*by, must(F.col("low_").eqNullSafe(F.col("high_")), F.col("low_"), f"{value} has several values for one key").alias(value))


def exactly_one(left: DataFrame, right: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """``left`` with the columns of its one row on the right; none or several fail.
    Right rows are counted by key before the join, so a hot key does not multiply."""
    one = right.groupBy(*on).agg(F.count("*").alias("n_"), *(F.first(c).alias(c) for c in take))
    found = left.join(one, on, "left")
    return found.select(*left.columns, *(must(F.col("n_") == 1, F.col(c), f"{c}: a row needs exactly one match").alias(c) for c in take))


def minutes_played(starter: Column, on: Column, off: Column, length: Column) -> Column:
    """Minutes on the field; zero for who never came on. A substitute who goes off
    without having come on, and an end before the start, fail."""
    began = F.when(starter, F.lit(0)).otherwise(on)
    ended = F.coalesce(off, length)
    ok = F.when(began.isNull(), off.isNull()).otherwise(ended >= began)
    return must(ok, F.when(began.isNull(), F.lit(0)).otherwise(ended - began), "substitution times contradict each other")


def within(value: Column, low: float, high: float, slack: float, message: str) -> Column:
    """The value, moved to the bounds where it passes them by at most the slack; farther fails."""
    ok = value.isNull() | value.between(low - slack, high + slack)
    return must(ok, F.greatest(F.lit(low), F.least(F.lit(high), value)), message)
