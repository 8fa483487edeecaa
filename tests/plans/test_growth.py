"""What queries stage and shuffle, so that disk and tasks grow no faster than the tables."""

import re

import pytest

from tallymill.plans.catalog import QUERIES
from tallymill.sources.staging import Staging

FOLDER = "/root/testdata/sf0.001"


def shuffled(df):
    """The keys of the plan's shuffles by hash."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_printed_words_are_neither_staged_nor_shuffled(spark, monkeypatch):
    monkeypatch.setattr(Staging, "keep", lambda *_: pytest.fail("words are staged"))
    df = QUERIES["printed_attempts"](spark, FOLDER)
    assert [k.split("#")[0] for k in shuffled(df)] == ["k"] and df.count() > 0


def test_marks_of_a_map_are_shuffled_by_map_alone(spark):
    """By colour they would lie in as many tasks as there are colours."""
    for name in ("cross_map", "enriched_records"):
        assert {k.split("#")[0] for k in shuffled(QUERIES[name](spark, FOLDER))} == {"k"}
    assert not any(k.startswith("l_returnflag#") and "," not in k for k in shuffled(QUERIES["keyed_markers"](spark, FOLDER)))


def test_reports_are_dealt_before_they_unfold(spark):
    """Else every figure of every report is shuffled."""
    assert {k.split("#")[0] for k in shuffled(QUERIES["domain_checks"](spark, FOLDER))} == {"k", "check"}


def test_no_check_was_dropped():
    from tallymill.plans import gates

    ids = [i for i, *_ in gates.CHECKS]
    assert len(ids) == len(set(ids)) == 31 and {"marker-count", "possession-sum", "zone-sum", "top5-percent", "row-bound", "total-of-lines"} <= set(ids)


def test_values_above_labels_meet_few(spark):
    """Rows that the joins of the search put out grow with the points, not with their square; results are those of all pairs."""
    import random

    from pyspark.sql import functions as F

    from tallymill.operators import spatial

    rng = random.Random(8)
    points = [(k, rng.uniform(0, 6), rng.choice((rng.uniform(0, 300), 40.0))) for k in range(1200)]
    df = spark.createDataFrame(points, "id long, x double, y double").withColumn("page", F.lit(1))
    labels, values = df.where("id % 2 = 0").withColumnRenamed("id", "label"), df.where("id % 2 = 1").withColumnRenamed("id", "value")
    got = {r.label: r.value for r in spatial.value_above(labels, values, ["page"], 3.0, 80.0).collect()}
    want = {}
    for i, x, y in points[::2]:
        near = [(b - y, j) for j, a, b in points[1::2] if abs(x - a) <= 3.0 and b > y and b - y <= 80.0]
        if near:
            want[i] = min(near)[1]
    assert got == want and spatial.value_above(labels, values.where("false"), ["page"], 3.0, 80.0).count() == 0
    joins = []
    real = spatial.Staging.keep
    spatial_keep = lambda self, d, tag: joins.append(tag) or real(self, d, tag)
    spatial.Staging.keep = spatial_keep
    try:
        spatial.value_above(labels, values, ["page"], 3.0, 80.0)
    finally:
        spatial.Staging.keep = real
    assert joins.count("met") > 1  # low cells first, higher ones for the rest
