"""Joins that must come out exactly: one to one, by key or else by name, by a derived stamp.

A row that contradicts the rule fails the query with a message; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators import gates
from tallymill.operators.matching import must


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], take: list[str], agree: dict[str, str] | None = None) -> DataFrame:
    """``left`` with columns of its row on the right. A row with no or several rows on the
    right, a right row that two left rows want, and a row whose column differs from the one
    on the right that ``agree`` names for it, fail. Right rows that nobody wants are no
    error. The count on the left runs over the partitions of the join, so it adds no shuffle."""
    other = {c: f"told_{k}_" for k, c in enumerate(agree or {})}
    one = right.groupBy(*on).agg(F.count("*").alias("n_"), *(F.first(c).alias(c) for c in take), *(F.first(agree[c]).alias(o) for c, o in other.items()))
    found = left.withColumn("same_", F.count("*").over(Window.partitionBy(*on))).join(one, on, "left")
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()]

    def checked(c: str):
        # the outermost rule is asked first
        value = F.col(c)
        for name, ok in zip(other, same):
            value = must(ok, value, f"{name} contradicts the match")
        value = must(F.col("same_") == 1, value, f"{c}: two rows want one match")
        value = must(F.col("n_") == 1, value, f"{c}: a row needs exactly one match")
        return value.alias(c)

    return found.select(*left.columns, *map(checked, take))


def by_key_else_name(facts: DataFrame, dim: DataFrame, key: str, name: str, take: str) -> DataFrame:
    """``facts`` with ``take`` of ``dim(key, name, take)``. A row with a key is looked up by it
    and must bear the name found there; only a row without a key goes by its name, which
    one row of ``dim`` must bear. The two kinds are joined apart, so rows without a key
    do not meet in one partition."""
    d = dim.select(F.col(key).alias(key), F.col(name).alias("named_"), F.col(take).alias(take))
    keyed = gates.exactly_one(facts.where(F.col(key).isNotNull()), d, [key], ["named_", take])
    keyed = keyed.select(*facts.columns, must(F.col(name).eqNullSafe(F.col("named_")), F.col(take), f"{name} is not the name of its {key}").alias(take))
    named = gates.exactly_one(facts.where(F.col(key).isNull()), d.select(F.col("named_").alias(name), take), [name], [take])
    return keyed.unionByName(named)


def flagged_by_stamp(goals: DataFrame, shots: DataFrame, who: str, stamp: str, flag: str) -> DataFrame:
    """``goals`` with a flag that is true where a shot of the same player has the goal's very
    stamp. Each shot must find exactly one goal, a player's only goal too; a shot
    whose player has no goal or none at that stamp, and one that finds several, fail."""
    counted = goals.select(who, stamp).withColumn("goal_", F.lit(True))
    met = gates.exactly_one(shots.select(who, stamp), counted, [who, stamp], ["goal_"])
    # the gate's column is part of the result, so the optimizer keeps it
    hits = met.groupBy(who, stamp).agg(F.bool_and("goal_").alias(flag))
    met = goals.join(hits, [who, stamp], "full_outer")
    return met.select(*goals.columns, F.coalesce(F.col(flag), F.lit(False)).alias(flag))
