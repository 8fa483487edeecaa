"""Scores at the limits of a match, and totals of players who took the field.

Every rule that can be contradicted by another source is a gate in the plan: it fails
the query on the row that breaks it, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.matching import must

SHOOTOUT = r"^\((.+) win ([0-9]+)-([0-9]+) on [Pp]enalties\)$"


def shootout_score(prose: Column, home: Column, away: Column) -> Column:
    """``(home, away, home_won)`` of a shoot-out line; null without one. Another shape, a
    winner that is neither side, a level score and a score that gives the winner the
    smaller number fail."""
    part = lambda k: F.regexp_extract(prose, SHOOTOUT, k)
    a, b, won = part(2).cast("bigint"), part(3).cast("bigint"), part(1) == home
    score = F.struct(a.alias("home"), b.alias("away"), won.alias("home_won"))
    score = must(a != b, must((a > b) == won, score, "shoot-out winner has the smaller number"), "shoot-out ends level")
    score = must(prose.rlike(SHOOTOUT), must(won | (part(1) == away), score, "shoot-out winner is neither side"), "not a shoot-out line")
    return F.when(prose.isNotNull(), score)


def decided(covers: DataFrame, goals: DataFrame, match: str = "match_id") -> DataFrame:
    """Score after 90 minutes and after extra time, shoot-out, winner and how it was decided.

    ``covers`` has a row a match: ``home``, ``away`` (names), ``home_score``, ``away_score``
    (final, without shoot-outs), ``extra_time`` (what the clock says) and ``shootout`` (the
    printed line or null). ``goals`` has ``for_home`` and ``minute``, stoppage not counted.
    Goals that do not add up to the cover, goals past 90 on a clock that ends there, a
    shoot-out without extra time, and a level match after extra time without one fail.
    A group's draw has no winner. Goals are counted by match ahead of the join.
    """
    at = lambda limit, home: F.count_if((F.col("minute") <= limit) & (F.col("for_home") == home))
    counted = goals.groupBy(match).agg(
        at(90, True).alias("h90_"), at(90, False).alias("a90_"), at(120, True).alias("h120_"), at(120, False).alias("a120_"), F.count_if(F.col("minute") > 90).alias("late_")
    )
    met = covers.join(counted, match, "left").fillna(0, ["h90_", "a90_", "h120_", "a120_", "late_"])
    met = met.withColumn("shot_", shootout_score(F.col("shootout"), F.col("home"), F.col("away")))
    extra, shot, level = F.col("extra_time"), F.col("shot_"), F.col("home_score") == F.col("away_score")
    how = F.when(shot.isNotNull(), "shootout").when(extra, "extra-time").otherwise("regulation")
    how = must(shot.isNull() | extra, how, "a shoot-out without extra time")
    how = must(~extra | ~level | shot.isNotNull(), how, "level after extra time without a shoot-out")
    how = must(shot.isNull() | level, how, "a shoot-out of a match that is not level")
    how = must(extra | (F.col("late_") == 0), how, "goals past 90 on a clock that ends there")
    how = must((F.col("h120_") == F.col("home_score")) & (F.col("a120_") == F.col("away_score")), how, "goals do not add up to the cover's score")
    ahead = F.when(shot.isNotNull(), shot["home_won"]).when(~level, F.col("home_score") > F.col("away_score"))
    return met.select(
        match, F.col("h90_").alias("home_90"), F.col("a90_").alias("away_90"), F.when(extra, F.col("home_score")).alias("home_et"), F.when(extra, F.col("away_score")).alias("away_et"),
        shot["home"].alias("home_shootout"), shot["away"].alias("away_shootout"), F.when(ahead, F.col("home")).when(~ahead, F.col("away")).alias("winner"), how.alias("decided_by"),
    )


def took_the_field(starter: Column, on: Column, off: Column) -> Column:
    """A starter always did, a substitute with a minute of coming on; a substitute who goes
    off without one fails."""
    return must(starter | on.isNotNull() | off.isNull(), starter | on.isNotNull(), "a substitute went off without having come on")


def player_metrics(players: DataFrame, records: DataFrame, key: str, metrics: Sequence[tuple[str, str, bool]], minutes: str, ratio: tuple[str, str, str]) -> DataFrame:
    """Long ``(key, metric, aggregation, value, per_ninety)``: every player has every metric.

    ``metrics`` are ``(column, 'sum' | 'max' | 'average', per ninety)``; the one average is
    ``ratio``'s ``(metric, part, whole)`` in per cent, of the sums. ``records`` are those of
    players who took the field. Without records sums and maxima are zero; a rate is null
    without minutes, for maxima and for percentages. One pass over the records.
    """
    kinds = {m: (how, rate) for m, how, rate in metrics}
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,4)")).cast("double")
    sums = [exact(m).alias(m) if how == "sum" else F.max(F.col(m).cast("double")).alias(m) for m, how, _ in metrics if how != "average"]
    totals = records.groupBy(key).agg(*sums, exact(ratio[1]).alias("part_"), exact(ratio[2]).alias("whole_"), F.sum(minutes).cast("bigint").alias("minutes_"))
    totals = totals.withColumn(ratio[0], F.try_divide(F.col("part_"), F.col("whole_")) * 100)
    wide = players.select(key).join(totals, key, "left").select(key, "minutes_", *(F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in kinds))
    long = wide.unpivot([key, "minutes_"], list(kinds), "metric", "value")
    table = F.create_map(*(F.lit(x) for m, (how, _) in kinds.items() for x in (m, how)))
    rated = F.col("metric").isin([m for m, (_, rate) in kinds.items() if rate]) & (F.col("minutes_") > 0)
    return long.select(key, "metric", table[F.col("metric")].alias("aggregation"), "value", F.when(rated, F.col("value") / F.col("minutes_") * 90).alias("per_ninety"))
