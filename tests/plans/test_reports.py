"""Readers of pages, covers, tables, maps and charts on constructed cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymill.operators import readers
from tallymill.sources import spans

PAGE = '<html><head><title>no</title></head><body><h1>A &amp; B</h1><p>one <b>two</b><br>three</p><script>var t="</p>";</script><p> </p><!-- <p>x</p> --></body></html>'


def test_spans_of_a_page():
    got = [(y0, x0, x1, t) for _, x0, y0, x1, _, t in spans.page_spans(PAGE)]
    assert got == [(12.0, 0.0, 25.0, "A & B"), (36.0, 0.0, 20.0, "one "), (36.0, 20.0, 35.0, "two"), (48.0, 0.0, 25.0, "three")]


def test_a_bad_page_is_reported_and_the_others_are_kept(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (2, "<html><body>cut", "y"), (3, None, "z"), (4, "<body></body>", None), (1, PAGE, "x"), (None, PAGE, "n")], "id long, html string, text string")
    got = spans.spans(df, "id").collect()
    assert sorted((r.id, r.error) for r in got if r.error) == [(2, "no complete body"), (3, "no page")]
    assert sum(r.id == 1 for r in got) == 8 and sum(r.id is None for r in got) == 4 and not any(r.id == 4 for r in got)
    assert spans.spans(df.where("false"), "id").count() == 0


def test_spans_as_a_table_function(spark):
    spans.register(spark)
    spark.createDataFrame([(1, PAGE), (2, None)], "id long, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT id, s.text, s.error FROM some_pages, LATERAL page_spans(html) s").collect()
    assert sorted((r.id, r.text or r.error) for r in got) == [(1, "A & B"), (1, "one "), (1, "three"), (1, "two"), (2, "no page")]


COVER = ["Spain 2 - 1 Cabo Verde", "Group H", "3 June 2026", "9:05 Kick Off", "Big Stadium", "Post Match Report"]


@pytest.mark.parametrize(
    ("lines", "problem"),
    [
        (COVER, None), (["(x)", *COVER], None), ([COVER[0], "(Spain win 4-3 on penalties)", *COVER[1:]], None), (["A 1 - 0 B (aet)", *COVER[1:]], None),
        (COVER[:2] + COVER[3:], "no date line"), ([*COVER, "4 June 2026"], "several date lines"), (COVER[:3] + COVER[4:], "no kick-off line"), ([*COVER, "9:06 Kick Off"], "several kick-off lines"),
        ([*COVER[:2], "3 Smarch 2026", *COVER[3:]], "unknown month"), ([*COVER[:2], "31 June 2026", *COVER[3:]], "not a real date"), ([*COVER[:3], "x", *COVER[3:]], "kick-off not below the date"),
        (COVER[1:], "no scoreline and stage"), (["x", COVER[0], *COVER[2:]], "no stage line"), (["(A win 1-0 on Penalties)", *COVER[1:]], "shoot-out without scoreline"), (["Spain", *COVER[1:]], "not a scoreline"),
        (COVER[:5], "no venue and title"), ([*COVER[:4], "Post Match Report", "x"], "not a venue"), ([*COVER[:5], "x"], "no title below the venue"), (["A 1 - 0 (B)", *COVER[1:]], "no away team"),
    ],
)
def test_cover_rules(spark, lines, problem):
    rows = [("r", k, t) for k, t in enumerate(lines)] + [("good", k, t) for k, t in enumerate(COVER)]
    got = {r.report: r for r in spans.covers(spark.createDataFrame(rows, "report string, n int, t string"), "report", "n", "t", "Post Match Report").collect()}
    assert got["good"].problem is None and (got["good"].home, got["good"].away_score, got["good"].group, got["good"].kickoff, str(got["good"].match_date)) == ("Spain", 1, "H", "09:05", "2026-06-03")
    assert got["r"].problem == problem and (got["r"].home is None) == (problem is not None)
    if "(aet)" in lines[0]:
        assert got["r"].away == "B" and got["r"].note
    if len(lines) > 1 and "penalties" in lines[1]:
        assert got["r"].shootout == lines[1]


HEAD = [(60.0, x, t) for x, t in ((10.0, "Time"), (60.0, "Player"), (200.0, "Outcome"), (300.0, "Body"), (330.0, "Part"), (400.0, "Delivery"))]
ROW = [(81.5, 10.0, "7"), (80.0, 59.2, "9"), (80.0, 90.0, "Ann"), (82.9, 200.0, "Goal"), (80.0, 300.0, "Head"), (80.0, 400.0, "Corner")]


def read(spark, words):
    rows = [(1, page, k, x, y, t) for page, found in enumerate(words) for k, (y, x, t) in enumerate(found)]
    df = spark.createDataFrame(rows, "k int, page int, word long, x double, y double, text string")
    return readers.attempts(df, "k", "page", {"Goal": "goal"}, {"Head": "head"}, {"Corner": "corner"}).orderBy("ordinal").collect()


def test_attempts_over_pages(spark):
    later = [(y + 20, x, "45" if t == "7" else t) for y, x, t in ROW]
    got = read(spark, [HEAD + ROW + later + [(200.0, 10.0, "Page")], HEAD + ROW, HEAD])
    assert [(r.page, r.ordinal, r.minute, r.shirt, r.player, r.outcome, r.body_part, r.delivery) for r in got] == [(0, 1, 7, 9, "Ann", "goal", "head", "corner"), (0, 2, 45, 9, "Ann", "goal", "head", "corner"), (1, 3, 7, 9, "Ann", "goal", "head", "corner")]


@pytest.mark.parametrize(
    ("page", "message"),
    [
        (ROW, "exactly one header"), (HEAD + ROW + [(y + 99, x, t) for y, x, t in HEAD], "exactly one header"), (HEAD[:-1] + ROW, "do not cut"), (HEAD + [(60.0, 500.0, "Body")] + ROW, "do not cut"),
        ([(y, 900.0 if t == "Player" else x, t) for y, x, t in HEAD] + ROW, "do not cut"), (HEAD + ROW + [(80.0, 20.0, "8")], "time cell"), (HEAD + [w for w in ROW if w[2] != "Ann"], "player cell"), (HEAD + [(y, x, "Gaol" if t == "Goal" else t) for y, x, t in ROW], "unknown label: Gaol"),
    ],
)
def test_attempts_that_resist_fail(spark, page, message):
    with pytest.raises(PySparkException, match=message):
        read(spark, [page])


def draw(spark, marks, frames=((1, 0.0, 0.0, 100.0, 200.0),)):
    m = spark.createDataFrame([(1, k, "curve", True, x, y, 11.0, 11.0, c) for k, (x, y, c) in enumerate(marks)], "k int, mark long, kind string, filled boolean, x double, y double, w double, h double, colour string")
    f = spark.createDataFrame([(1, *x) for x in frames], "k int, frame int, x0 double, y0 double, x1 double, y1 double")
    key = spark.createDataFrame([("g", "done"), ("r", "tried"), ("b", "blocked")], "colour string, outcome string")
    return [(r.mark, r.outcome, r.x, r.y) for r in readers.read_map(m, f, ["k"], key, (8.0, 15.0), (1000.0, 50_000.0), collapse=("tried", "done")).orderBy("position").collect()]


def test_map_rules(spark):
    got = draw(spark, [(10.0, 100.0, "g"), (10.0, 100.0, "r"), (50.0, -0.5, "r"), (20.0, 200.4, "g"), (30.0, 200.4, "r"), (40.0, 200.4, "b"), (101.5, 50.0, "g")])
    assert got == [(2, "tried", 100.0, 50.0), (0, "done", 50.0, 10.0)]
    with pytest.raises(PySparkException, match="colour without meaning"):
        draw(spark, [(10.0, 100.0, "grey")])
    with pytest.raises(PySparkException, match="outside the pitch"):
        draw(spark, [(10.0, -0.9, "g")], frames=((1, 0.0, 0.0, 100.0, 100.0),))


PITCH, UNIT = 4.0, 2.5


def bar(slot, side, n, width=0.7, base=110.0):
    mid = 10 + (slot + 0.5) * PITCH
    return (1, side, mid - width * PITCH / 2, base - (n * UNIT if side == "home" else 0), mid + width * PITCH / 2, base + (n * UNIT if side == "away" else 0))


GOOD = [bar(0, "home", 4), bar(3, "away", 3), bar(3, "home", 1), bar(49, "away", 2)]
TICKS = [("15", 70.0), ("45", 190.0), ("90", 300.0)]


def chart(spark, bars, ticks=TICKS, bottom=120.0):
    b = spark.createDataFrame(bars, "chart int, side string, x0 double, y0 double, x1 double, y1 double")
    a = spark.createDataFrame([(1, 10.0, 210.0, 100.0, bottom, 4)], "chart int, x0 double, x1 double, top double, bottom double, top_label int")
    t = spark.createDataFrame([(1, *x) for x in ticks], "chart int, label string, x double")
    return readers.read_charts(b, a, t, "chart").orderBy("slot").collect()


def test_chart_comes_back(spark):
    got = chart(spark, GOOD)
    assert [r.slot for r in got] == list(range(50))
    assert {r.slot: (r.home, r.away) for r in got if r.home or r.away} == {0: (4, 0), 3: (1, 3), 49: (0, 2)}
    noisy = [(c, s, x0 + 0.003, y0 - 0.004, x1 + 0.003, y1 + 0.004) for c, s, x0, y0, x1, y1 in GOOD]
    assert [(r.home, r.away) for r in chart(spark, noisy)] == [(r.home, r.away) for r in got]
    assert [(r.slot, r.home, r.warning) for r in chart(spark, [(2, *GOOD[0][1:])])] == [(None, None, "the chart draws no bars")]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"bars": [bar(0, "home", 4), bar(3, "home", 0.8), bar(5, "home", 4.046 / UNIT)]}, "whole number of units"), ({"bars": [*GOOD, bar(5.4, "home", 2)]}, "slot's centre"), ({"bars": [*GOOD, bar(0, "home", 2)]}, "two bars of one side"),
        ({"bars": [*GOOD, bar(60, "home", 2)]}, "slot's centre|disagree"), ({"bars": [*GOOD, bar(5, "home", 2, width=0.5)]}, "bar's width"), ({"bars": [*GOOD, bar(5, "home", 2, base=111.0)]}, "one baseline"),
        ({"bars": [bar(k, "home", 4, base=112.0) for k in (0, 1)]}, "middle of the axis"), ({"bars": GOOD[1:]}, "does not fill"), ({"bars": [*GOOD, (1, "grey", *bar(5, "away", 2)[2:])]}, "neither side"),
        ({"ticks": TICKS[1:]}, "once each"), ({"ticks": [*TICKS, ("15", 80.0)]}, "once each"), ({"ticks": [("15", 70.0), ("45", 180.0)]}, "disagree"), ({"ticks": [("15", 190.0), ("45", 70.0)]}, "once each"),
    ],
)
def test_charts_that_contradict_themselves_fail(spark, change, message):
    with pytest.raises(PySparkException, match=message):
        chart(spark, change.get("bars", GOOD), change.get("ticks", TICKS))


def test_step_of_noisy_multiples(spark):
    values = [[2.4, 4.8, 12.0], [2.401, 4.799, 7.2, 9.602], [5.0], [6.0, 10.0]]
    got = spark.createDataFrame([(v,) for v in values], "v array<double>").select(readers.nearest_step(F.col("v"), 0.05).alias("s")).collect()
    assert [round(r.s, 1) for r in got] == [2.4, 2.4, 5.0, 2.0]
