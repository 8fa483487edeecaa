"""Operators on ordered rows: clocks, periods, runs, grouping by an anchor."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def periods(df: DataFrame, by: list[str], order: list[str], minute: str, bounds: tuple[int, ...], name: str = "period") -> DataFrame:
    """Period of each event by its minute's range, corrected where a later event's
    clock shows that an earlier period still ran: right to left the period never
    exceeds the next one, and drops by one where the clock goes back, never below
    zero. Written as two windows: with C the clock's drops so far and b the range
    period, it is max(0, C + min over the rest of (b - C))."""
    w = Window.partitionBy(*by).orderBy(*order)
    b = sum((F.col(minute) > x).cast("int") for x in bounds)
    back = F.coalesce((F.col(minute) < F.lag(minute).over(w)).cast("int"), F.lit(0))
    df = df.withColumn("b_", b).withColumn("back_", back)
    df = df.withColumn("c_", F.sum("back_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the rest of a group is what comes first in the reversed order: a running minimum
    reverse = Window.partitionBy(*by).orderBy(*(F.desc(o) for o in order))
    rest = F.min(F.col("b_") - F.col("c_")).over(reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.greatest(F.lit(0), F.col("c_") + rest).cast("bigint")).drop("b_", "back_", "c_")


def previous(df: DataFrame, by: list[str], order: list[str], value: str, bucket: Column, name: str = "previous") -> DataFrame:
    """The value of the row before within ``by``, as a lag would give it, with groups dealt
    to tasks by a ``bucket`` that grows with the order: rows look back within their bucket,
    and the first of each takes the last value of the nearest bucket before, from a
    table of one row a bucket."""
    celled = df.withColumn("bucket_", bucket)
    last = celled.groupBy(*by, "bucket_").agg(F.max_by(F.struct(value), F.struct(*order)).alias("last_"))
    before = last.select(*by, "bucket_", F.lag("last_").over(Window.partitionBy(*by).orderBy("bucket_")).alias("before_"))
    w = Window.partitionBy(*by, "bucket_").orderBy(*order)
    own = celled.withColumn("lag_", F.lag(F.struct(value)).over(w))
    same = F.col("o.bucket_").eqNullSafe(F.col("b.bucket_"))
    for c in by:
        same &= F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = own.alias("o").join(before.alias("b"), same, "left").select("o.*", "before_")
    return met.withColumn(name, F.coalesce("lag_", "before_")[value]).drop("bucket_", "lag_", "before_")


def stamp(minute: Column, bounds: tuple[int, ...] = (45, 90, 105, 120), period: Column | None = None) -> tuple[Column, Column]:
    """``(minute, stoppage)``: minutes beyond a period's bound become stoppage."""
    at = F.element_at(F.array(*map(F.lit, bounds)), (period if period is not None else F.lit(0)) + 1)
    over = minute > at
    return F.when(over, at).otherwise(minute), F.when(over, minute - at)


def increases(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``(by, strictly_increasing)``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("up_", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True))).groupBy(*by).agg(F.bool_and("up_").alias("strictly_increasing"))


def joined_fragments(df: DataFrame, by: list[str], start: str, end: str, text: str, gap: float = 1.0) -> DataFrame:
    """Fragments of a row from left to right, with a space where the gap to the one before is wider than ``gap``."""
    w = Window.partitionBy(*by).orderBy(start, text)
    apart = F.when(F.col(start) - F.lag(end).over(w) > gap, F.lit(" ")).otherwise(F.lit(""))
    parts = df.withColumn("part_", F.concat(apart, F.col(text)))
    return parts.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(start), F.col(text), F.col("part_")))), lambda x: x["part_"]), "").alias("joined"))


def appearances(games: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``(match_id, round)``: one more than the more-played side's earlier games within ``by``."""
    both = games.select("match_id", by, *order, F.explode(F.array("home", "away")).alias("team"))
    w = Window.partitionBy(by, "team").orderBy(*order, "match_id")
    return both.withColumn("n", F.row_number().over(w)).groupBy("match_id").agg(F.max("n").cast("bigint").alias("round"))


def first_and_last(df: DataFrame, by: list[str], key: Column, order: str) -> DataFrame:
    """The first row of each key, and always the last row."""
    w, whole = Window.partitionBy(*by, key).orderBy(order), Window.partitionBy(*by)
    marked = df.withColumn("first_", F.row_number().over(w) == 1).withColumn("last_", F.col(order) == F.max(order).over(whole))
    return marked.where("first_ or last_").drop("first_", "last_")


def half_gaps(df: DataFrame, by: list[str], position: str, most: float) -> DataFrame:
    """Half the distance to the nearer neighbour, at most ``most``."""
    w = Window.partitionBy(*by).orderBy(position)
    before, after = F.col(position) - F.lag(position).over(w), F.lead(position).over(w) - F.col(position)
    return df.withColumn("half_width", F.least(F.lit(most), F.coalesce(F.least(before, after), before, after, F.lit(2 * most)) / 2))


def collapse_pairs(df: DataFrame, by: list[str], outcome: str, weak: str, strong: str) -> DataFrame:
    """Where exactly two rows share a position with the outcomes weak and strong, the strong one stays."""
    w = Window.partitionBy(*by)
    pair = (F.count("*").over(w) == 2) & (F.sort_array(F.collect_set(outcome).over(w)) == F.sort_array(F.array(F.lit(weak), F.lit(strong))))
    return df.withColumn("pair_", pair).where(~F.col("pair_") | (F.col(outcome) == strong)).drop("pair_")


def common_step(value: str, tolerance: float = 0.05) -> Column:
    """An aggregate of distinct positive values: the largest step of which all are
    multiples up to the tolerance. Remainders are to the nearest multiple, so noise
    below a multiple counts as noise and not as a residue. Groups are sets of values
    on one axis, so one Arrow batch holds a group."""

    def meet(a: float, b: float) -> float:
        while b > tolerance:
            a, b = b, abs(math.remainder(a, b))
        return a

    @F.pandas_udf("double")
    def step(v: pd.Series) -> float:
        return float(reduce(lambda x, y: meet(max(x, y), min(x, y)), sorted(v)))

    return step(value)
