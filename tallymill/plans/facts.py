"""Match- and player-level facts as logical plans over the driver tables.

A match is an order with lines: home is the customer's nation, away the nation
of the order's lowest supplier, goals are its returned ('R') and accepted ('A')
lines. A player-match row is an order's lines of one supplier. Sums run over
decimals, so their value does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.sources.tables import table

METRICS = ("quantity", "revenue", "discount", "tax")
EXACT = "decimal(18,4)"


def exact_sum(column) -> F.Column:
    """Sum of a two-decimal measure, the same in every order of rows."""
    return F.sum(F.col(column).cast(EXACT) if isinstance(column, str) else column.cast(EXACT)).cast("double")


def exact_avg(column) -> F.Column:
    """Unweighted mean of the non-null values, from the exact sum."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast(EXACT)).cast("double") / F.count(c)


def player_match(spark: SparkSession, d: str) -> DataFrame:
    """``(match_id, player_id, quantity, revenue, discount, tax, lines)``; a zero discount counts as not measured."""
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id")).agg(
        exact_sum("l_quantity").alias("quantity"), exact_sum("l_extendedprice").alias("revenue"), exact_sum(F.expr("nullif(l_discount, 0)")).alias("discount"),
        exact_sum("l_tax").alias("tax"), F.count("*").alias("lines"),
    )


def matches(spark: SparkSession, d: str) -> DataFrame:
    """``(match_id, match_date, stage, home, away, home_goals, away_goals)``; nations by key."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"), F.count_if(F.col("l_returnflag") == "R").alias("home_goals"), F.count_if(F.col("l_returnflag") == "A").alias("away_goals"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("away"))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, "o_custkey").join(supplier, "s_suppkey")
    return joined.where("home <> away").select(
        F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("match_date"), F.substring("o_orderpriority", 1, 1).cast("int").alias("stage"), "home", "away", "home_goals", "away_goals"
    )


def sides(games: DataFrame) -> DataFrame:
    """Two rows a match, one for each side: ``(match_id, match_date, stage, team, opponent, goals_for, goals_against, is_home)``."""
    row = lambda t, o, gf, ga, home: F.struct(F.col(t).alias("team"), F.col(o).alias("opponent"), F.col(gf).alias("goals_for"), F.col(ga).alias("goals_against"), F.lit(home).alias("is_home"))
    both = F.array(row("home", "away", "home_goals", "away_goals", True), row("away", "home", "away_goals", "home_goals", False))
    return games.select("match_id", "match_date", "stage", F.explode(both).alias("s")).select("match_id", "match_date", "stage", "s.*")


def unpivoted(facts: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Long form ``(keys, metric, value)``; nulls stay and are skipped by aggregates."""
    return facts.unpivot(keys, list(metrics), "metric", "value")
