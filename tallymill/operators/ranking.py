"""Ranks, tie-safe caps, quantile bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competition_rank(df: DataFrame, by: list[str], value: str, higher: Column | bool = True, name: str = "rank") -> DataFrame:
    """1, 2, 2, 4 within ``by``; ``higher`` says, row by row if need be, whether large values lead."""
    lead = F.when(F.lit(higher) if isinstance(higher, bool) else higher, -F.col(value)).otherwise(F.col(value))
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(lead)).cast("bigint"))


def cap_with_ties(df: DataFrame, cap: int, rank: str = "rank", where: Column | None = None) -> DataFrame:
    """Rows up to the cap with all that tie at it: ranks skip over ties, so a
    filter on the rank is the whole rule. ``where`` limits the cap to some rows."""
    ok = F.col(rank) <= cap
    return df.where(ok if where is None else ~where | ok)


def total_rank(df: DataFrame, by: list[str], keys: list[Column], name: str = "rank", last: str | None = None) -> DataFrame:
    """Rank by keys that must be a total order within ``by``: rows that tie on all
    keys fail the query. With ``last`` that column settles ties, and ``tied`` shows them."""
    w = Window.partitionBy(*by)
    marked = df.withColumns({f"k{i}_": k for i, k in enumerate(keys)})
    names = [f"k{i}_" for i in range(len(keys))]
    tied = F.count("*").over(Window.partitionBy(*by, *names))
    order = w.orderBy(*(F.col(n).desc() for n in names), *([last] if last else []))
    ranked = marked.withColumn("tied_", tied).withColumn(name, F.row_number().over(order).cast("bigint"))
    if last:
        return ranked.withColumn("tied", F.col("tied_") > 1).drop("tied_", *names)
    checked = F.when(F.col("tied_") > 1, F.raise_error(F.lit("standings keys tie"))).otherwise(F.col(name))
    return ranked.withColumn(name, checked).drop("tied_", *names)


def quantile_thresholds(df: DataFrame, by: list[str], value: str, parts: int = 5) -> DataFrame:
    """``(by, thresholds)``: nearest-rank cut points 1..parts-1, empty for fewer than two distinct values."""
    cuts = F.array(*(F.expr(f"percentile_disc({k / parts}) within group (order by {value})") for k in range(1, parts)))
    return df.groupBy(*by).agg(cuts.alias("cuts"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(*by, F.when(F.col("lo") < F.col("hi"), F.col("cuts")).otherwise(F.slice("cuts", 1, 0)).alias("thresholds"))


def band_of(value: Column, thresholds: Column) -> Column:
    """1 + thresholds strictly below the value; equal values share a band, null is band 1."""
    return F.coalesce(F.size(F.filter(thresholds, lambda t: t < value)) + 1, F.lit(1)).cast("bigint")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col(name) <= k)


def table_positions(df: DataFrame, orders: dict[str, Column], key: str, id_: str, width: int = 8192) -> DataFrame:
    """Row numbers over the whole table, a column for each of ``orders`` of ``key``;
    ties go by ``id_``. Rows are numbered within cells of a key and ``width`` ids,
    and the sizes of the cells before are added, so no task holds all rows."""
    celled = df.withColumn("cell_", F.floor(F.col(id_) / width))
    own = celled.withColumn("k_", F.row_number().over(Window.partitionBy(key, "cell_").orderBy(id_)))
    sizes = celled.groupBy(F.col(key).alias("key_"), F.col("cell_").alias("at_")).agg(F.count("*").alias("n_"))
    # one row for each cell: a table of N ids and K keys has K * N / width of them
    before = lambda o: F.sum("n_").over(Window.orderBy(o, "at_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("key_", "at_", *(F.coalesce(before(o), F.lit(0)).alias(f"b_{name}") for name, o in orders.items()))
    met = own.join(sizes, F.col(key).eqNullSafe(F.col("key_")) & F.col("cell_").eqNullSafe(F.col("at_")))
    return met.select(*df.columns, *((F.col("k_") + F.col(f"b_{name}")).cast("bigint").alias(name) for name in orders))
