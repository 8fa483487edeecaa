"""Scores at the limits with each rule that fails, metrics of players, places of terms."""

import pytest
from pyspark.sql import functions as F

from tallymill.functions import text
from tallymill.operators import scores
from tallymill.plans.catalog import QUERIES
from tallymill.plans.tournament import PLAYER_METRICS

COVER = "match_id int, home string, away string, home_score int, away_score int, extra_time boolean, shootout string"
GOAL = "match_id int, minute int, for_home boolean"


def decided(spark, covers, goals):
    return [tuple(r)[1:] for r in scores.decided(spark.createDataFrame(covers, COVER), spark.createDataFrame(goals, GOAL)).orderBy("match_id").collect()]


def test_decided(spark):
    covers = [
        (1, "A", "B", 2, 1, False, None), (2, "A", "B", 0, 0, False, None), (3, "A", "B", 1, 2, True, None),
        (4, "A", "B", 1, 1, True, "(B win 3-4 on Penalties)"), (5, "A (x)", "B", 0, 0, True, "(A (x) win 5-4 on penalties)"),
    ]
    goals = [(1, 3, True), (1, 90, True), (1, 45, False), (3, 20, True), (3, 80, False), (3, 91, False), (4, 90, True), (4, 120, False)]
    assert decided(spark, covers, goals) == [
        (2, 1, None, None, None, None, "A", "regulation"), (0, 0, None, None, None, None, None, "regulation"), (1, 1, 1, 2, None, None, "B", "extra-time"),
        (1, 0, 1, 1, 3, 4, "B", "shootout"), (0, 0, 0, 0, 5, 4, "A (x)", "shootout"),
    ]


@pytest.mark.parametrize(
    "cover,goals,message",
    [
        ((1, "A", "B", 1, 0, False, None), [], "do not add up"),
        ((1, "A", "B", 1, 0, False, None), [(1, 100, True)], "goals past 90"),
        ((1, "A", "B", 0, 0, False, "(A win 4-3 on Penalties)"), [], "without extra time"),
        ((1, "A", "B", 0, 0, True, None), [], "level after extra time"),
        ((1, "A", "B", 1, 0, True, "(A win 4-3 on Penalties)"), [(1, 5, True)], "not level"),
        ((1, "A", "B", 0, 0, True, "(C win 4-3 on Penalties)"), [], "neither side"),
        ((1, "A", "B", 0, 0, True, "(A win 4-4 on Penalties)"), [], "ends level"),
        ((1, "A", "B", 0, 0, True, "(B win 4-3 on Penalties)"), [], "smaller number"),
        ((1, "A", "B", 0, 0, True, "A beat B 4-3"), [], "not a shoot-out line"),
        ((1, "A", "B", 0, 0, True, "1-1 (A win 4-3 on Penalties)"), [], "not a shoot-out line"),
    ],
)
def test_contradictions_fail(spark, cover, goals, message):
    with pytest.raises(Exception, match=message):
        decided(spark, [cover], goals)


def test_took_the_field(spark):
    rows = [(True, None, None), (False, 60, None), (False, None, None), (False, 60, 80)]
    df = spark.createDataFrame(rows, "starter boolean, on_ int, off int")
    field = scores.took_the_field(F.col("starter"), F.col("on_"), F.col("off"))
    assert [r[0] for r in df.select(field).collect()] == [True, True, False, True]
    with pytest.raises(Exception, match="without having come on"):
        spark.createDataFrame([(False, None, 70)], "starter boolean, on_ int, off int").select(field).collect()


def test_player_metrics(spark):
    players = spark.createDataFrame([(1,), (2,), (3,)], "player_id int")
    records = spark.createDataFrame([(1, 2, 30.5, 8, 10, 45), (1, 1, 31.5, 0, 10, 45), (3, 4, 20.0, 0, 0, 0)], "player_id int, goals int, speed double, done int, tried int, minutes int")
    metrics = (("goals", "sum", True), ("speed", "max", False), ("completion", "average", False))
    rows = scores.player_metrics(players, records, "player_id", metrics, "minutes", ("completion", "done", "tried")).collect()
    got = {(r.player_id, r.metric): (r.aggregation, r.value, r.per_ninety) for r in rows}
    assert len(rows) == 9
    assert got[1, "goals"] == ("sum", 3.0, 3.0) and got[1, "speed"] == ("max", 31.5, None) and got[1, "completion"] == ("average", 40.0, None)
    assert got[2, "goals"] == ("sum", 0.0, None) and got[2, "speed"] == ("max", 0.0, None) and got[2, "completion"] == ("average", 0.0, None)
    assert got[3, "goals"] == ("sum", 4.0, None) and got[3, "completion"][1] == 0.0


def test_every_player_has_every_metric(spark):
    rows = QUERIES["player_aggregates"](spark, "/root/testdata/sf0.001")
    assert len(PLAYER_METRICS) == 18 and rows.groupBy("player_id").count().where("count <> 18").count() == 0


def test_term_span(spark):
    said = ["Tiros de esquina", "los centros", "epicentro y centro", "MOMENTUM timeline", "nothing", "", None, "center", "İx centro"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    span = lambda term: [None if r[0] is None else tuple(r[0]) for r in df.select(text.term_span(F.col("s"), term)).collect()]
    assert span("tiro de esquina") == [(0, 16), None, None, None, None, None, None, None, None]
    assert span(" centro ") == [None, (4, 11), (12, 18), None, None, None, None, None, (3, 9)]
    assert span("momentum")[3] == (0, 8) and span("  ") == [None] * len(said) and span("a.b") == [None] * len(said)


def test_trend_point_of_no_match_fails(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1.0, 1.0, 0.0, 0.0)], "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, None)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    with pytest.raises(Exception, match="no match"):
        QUERIES["player_trend_or_fail"](spark, str(tmp_path)).collect()
