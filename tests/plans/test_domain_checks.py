"""Every check of the registry passes on a report that holds and fails on one that does not."""

import pytest

from tallymill.operators import domain_checks
from tallymill.plans.figures import GOOD

BY = ["match", "side"]


def stamps(series, minutes):
    return [(1, "home", series, k, m, s) for k, (m, s) in enumerate(minutes)]


CLOCK = [(m, None) for m in range(1, 46)] + [(45, 1), (45, 2)] + [(m, None) for m in range(46, 91)] + [(90, 1)]


def checked(spark, figures):
    df = spark.createDataFrame([(1, "home", k, float(v)) for k, v in figures.items()] + [(2, "away", k, float(v)) for k, v in GOOD.items()], "match int, side string, figure string, value double")
    rows = domain_checks.figure_checks(df, BY).collect()
    assert all(r.result == "pass" for r in rows if r.match == 2)
    return {(r.check, r.what): r.result for r in rows if r.match == 1}


def test_all_pass_on_a_report_that_holds(spark):
    got = checked(spark, GOOD)
    assert len(got) == len(domain_checks.CHECKS) and set(got.values()) == {"pass"}


def test_each_check_fails_when_any_of_its_figures_is_off(spark):
    rows = []
    cases = [(c, n) for c in domain_checks.CHECKS for n in c.needs]
    for k, (c, n) in enumerate(cases):
        step = 1000.0 if c.high != float("inf") and c.low != float("-inf") else 1000.0 if n == c.needs[0] else -1000.0
        if c.what.startswith("0 <="):
            step = 1000.0
        if c.what.startswith("100") or "100 *" in c.what:
            step = 50.0 if n != c.needs[1] else 1000.0
        rows += [(k, "home", f, float(v + (step if f == n else 0))) for f, v in GOOD.items()]
    got = domain_checks.figure_checks(spark.createDataFrame(rows, "match int, side string, figure string, value double"), BY).collect()
    failed = {(r.match, r.check, r.what) for r in got if r.result == "fail"}
    assert [(c.id, c.what, n) for k, (c, n) in enumerate(cases) if (k, c.id, c.what) not in failed] == []


@pytest.mark.parametrize(
    ("figure", "by", "check", "result"),
    [
        ("drawn.feet", 2, "goalkeeping-distribution-printed", "pass"), ("drawn.feet", 3, "goalkeeping-distribution-printed", "fail"), ("drawn.feet", -1, "goalkeeping-distribution-printed", "fail"), ("possession.own", 0.2, "key-statistics-possession-sum", "pass"),
        ("possession.own", 0.3, "key-statistics-possession-sum", "fail"), ("distance", 0.35, "domain-g-zone-sum", "pass"), ("distance", 0.36, "domain-g-zone-sum", "fail"), ("width", 18, "tactical-metre-bounds", "pass"), ("width", 18.1, "tactical-metre-bounds", "fail"), ("length", -GOOD["length"], "tactical-metre-bounds", "fail"),
    ],
)
def test_tolerances(spark, figure, by, check, result):
    got = {r for (c, _), r in checked(spark, GOOD | {figure: GOOD[figure] + by}).items() if c == check}
    assert ("fail" in got) == (result == "fail")


def test_absent_and_contradictory_figures(spark):
    got = checked(spark, {k: v for k, v in GOOD.items() if k != "shots.rows"} | {"passes": 0.0, "passes.completed": 0.0})
    assert got["shots-marker-count", "shots.markers = shots.rows"] == "not-applicable"
    assert got["key-statistics-internal-consistency", "passes.percent = 100 * passes.completed / passes"] == "not-applicable"
    df = spark.createDataFrame([(1, "home", "shots.markers", 3.0), (1, "home", "shots.markers", 4.0), (1, "home", "shots.rows", 3.0)], "match int, side string, figure string, value double")
    assert {r.check: r.result for r in domain_checks.figure_checks(df, BY).collect()}["shots-marker-count"] == "fail"


@pytest.mark.parametrize(("on", "result"), [([1, 2, 2], "pass"), ([2, 1, 2], "pass"), ([1, 2], "fail"), ([1, 1, 2], "fail"), ([1, 2, 2, 3], "fail"), ([], "fail")])
def test_lists_are_multisets(spark, on, result):
    rows = [(1, "home", "off", x) for x in (1, 2, 2)] + [(1, "home", "on", x) for x in on]
    got = domain_checks.list_checks(spark.createDataFrame(rows, "match int, side string, list string, item int"), BY).collect()
    assert [(r.check, r.result) for r in got] == [("domain-a-substitution-pairing", result)]


@pytest.mark.parametrize("series", ["involvement", "momentum"])
@pytest.mark.parametrize(
    ("minutes", "result"),
    [(CLOCK, "pass"), (CLOCK[1:], "fail"), (CLOCK[:40], "fail"), ([*CLOCK[:20], (20, None), *CLOCK[20:]], "fail"), (CLOCK + [(m, None) for m in range(91, 121)], "pass"), (CLOCK + [(m, None) for m in range(91, 100)], "fail"), ([(1, 1), *CLOCK[1:]], "fail")],
)
def test_clocks(spark, series, minutes, result):
    of = "match int, side string, series string, slot int, minute int, stoppage int"
    got = domain_checks.clock_checks(spark.createDataFrame(stamps(series, minutes), of), BY).collect()
    assert [r.result for r in got] == [result] and got[0].check in dict(domain_checks.CLOCKS)
    gap = [(*r[:3], r[3] + (r[3] > 10), *r[4:]) for r in stamps(series, CLOCK)]
    assert domain_checks.clock_checks(spark.createDataFrame(gap, of), BY).first().result == "fail"
