"""Joins that must come out exactly fail where the rule says so."""

import pytest

from tallymill.functions import numbers
from tallymill.operators import exact


def fails(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_one_to_one(spark):
    right = frame(spark, [("a", 7, "x"), ("b", 8, "y"), ("c", 9, None), ("d", 1, "p"), ("d", 2, "q")], "name string, shirt int, id string")
    of = lambda *rows: exact.one_to_one(frame(spark, rows, "name string, printed int"), right, ["name"], ["id"], {"printed": "shirt"})
    assert sorted(map(tuple, of(("a", 7), ("b", 8)).collect())) == [("a", 7, "x"), ("b", 8, "y")]
    assert of(("c", 9)).first().id is None
    fails(of(("e", 7)), "exactly one match")
    fails(of((None, 7)), "exactly one match")
    fails(of(("d", 1)), "exactly one match")
    fails(of(("a", 7), ("a", 7)), "two rows want one match")
    fails(of(("a", 8)), "printed contradicts the match")
    assert of(*[("a", 7)][:0]).count() == 0


def test_key_or_else_name(spark):
    dim = frame(spark, [(1, "one", "A"), (2, "two", "B"), (3, "same", "C"), (4, "same", "D")], "key int, name string, id string")
    of = lambda *rows: exact.by_key_else_name(frame(spark, rows, "n int, key int, name string"), dim, "key", "name", "id")
    assert sorted((r.n, r.id) for r in of((1, 1, "one"), (2, None, "two"), (3, 3, "same")).collect()) == [(1, "A"), (2, "B"), (3, "C")]
    fails(of((1, 1, "two")), "not the name of its key")
    fails(of((1, 9, "one")), "exactly one match")  # a key that is not there does not fall back to the name
    fails(of((1, None, "same")), "exactly one match")
    fails(of((1, None, "none")), "exactly one match")


def test_flag_by_stamp(spark):
    goals = frame(spark, [("p", 30), ("p", 70), ("q", 12), ("r", 5), ("r", 5)], "who string, at int")
    of = lambda *rows: exact.flagged_by_stamp(goals, frame(spark, rows, "who string, at int"), "who", "at", "penalty")
    assert sorted(map(tuple, of(("p", 70)).collect())) == [("p", 30, False), ("p", 70, True), ("q", 12, False), ("r", 5, False), ("r", 5, False)]
    fails(of(("q", 13)), "exactly one match")  # its only goal, at another minute
    fails(of(("s", 1)), "exactly one match")
    fails(of(("r", 5)), "exactly one match")


def test_axes_of_counts(spark):
    tops = frame(spark, [(0,), (1,), (9,), (11,), (17,), (40,), (41,)], "top int")
    got = {r.top: (r.step, r.end, r.ticks) for r in tops.select("top", numbers.count_step(tops.top, 4).alias("step"), numbers.count_axis_top(tops.top, 4).alias("end"), numbers.peak_ticks(tops.top).alias("ticks")).collect()}
    assert got[0][:2] == (1, 1) and got[9][:2] == (5, 10) and got[40][:2] == (10, 40) and got[41][:2] == (20, 60)
    assert got[17][2] == [-17, -10, 0, 10, 17] and got[11][2] == [-11, 0, 11] and got[0][2] == [-1, 0, 1] and got[40][2] == [-40, -20, 0, 20, 40]
