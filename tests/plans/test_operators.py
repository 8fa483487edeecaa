"""Rules of single operators on constructed cases."""

import gzip
import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymill.functions import numbers, text
from tallymill.operators import anchors, checks, matching, publish, ranking, sequence
from tallymill.plans.catalog import QUERIES
from tallymill.sources import tables
from tallymill.streaming import ingest


def col(df):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.collect()]


def test_competition_rank_and_cap(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([10.0, 9.0, 9.0, 8.0])], "id int, v double")
    ranked = ranking.competition_rank(df, [], "v")
    assert sorted(r["rank"] for r in ranked.collect()) == [1, 2, 2, 4]
    tied = ranking.competition_rank(spark.createDataFrame([(10.0,), (9.0,), (9.0,), (9.0,)], "v double"), [], "v")
    assert ranking.cap_with_ties(tied, 2).count() == 4
    plain = ranking.competition_rank(spark.createDataFrame([(4.0,), (3.0,), (2.0,), (1.0,)], "v double"), [], "v")
    assert ranking.cap_with_ties(plain, 2).count() == 2


def test_standings_tie_fails(spark):
    df = spark.createDataFrame([(1, 3, 1), (1, 3, 1)], "g int, p int, d int")
    with pytest.raises(PySparkException, match="tie"):
        ranking.total_rank(df, ["g"], [F.col("p"), F.col("d")]).collect()
    assert {r.tied for r in ranking.total_rank(df.withColumn("t", F.monotonically_increasing_id()), ["g"], [F.col("p"), F.col("d")], last="t").collect()} == {True}


def test_bands_share_ties_and_are_empty_without_spread(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 1, 1, 2, 9)] + [("b", 5), ("b", 5)], "g string, v int")
    t = {r.g: list(r.thresholds) for r in ranking.quantile_thresholds(df, ["g"], "v").collect()}
    assert t == {"a": [1, 1, 1, 2], "b": []}


def test_periods_equal_the_recurrence(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.randint(0, 125)) for g in range(40) for k in range(rng.randint(1, 12))]
    got = {(r.g, r.k): r.period for r in sequence.periods(spark.createDataFrame(rows, "g int, k int, m int"), ["g"], ["k"], "m", (45, 90, 105)).collect()}
    for g in range(40):
        minutes = [m for h, _, m in rows if h == g]
        want = [sum(m > b for b in (45, 90, 105)) for m in minutes]
        for k in range(len(minutes) - 2, -1, -1):
            want[k] = min(want[k], max(0, want[k + 1] - (minutes[k + 1] < minutes[k])))
        assert [got[g, k] for k in range(len(minutes))] == want


def test_anchor_is_the_first_of_the_group(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 1.5, 2), (1, 3.0, 3), (1, 3.5, 4)], "p int, y double, i long")
    assert [r["row"] for r in anchors.anchored_groups(df, ["p"], "y", "i", 2.0).orderBy("y").collect()] == [1, 1, 2, 2]


def test_nearest_prefers_exact_then_lower_id(spark):
    left = spark.createDataFrame([(1, 10, 5), (1, 20, 6), (1, 14, 7), (2, 1, 8)], "g int, t int, id int")
    right = spark.createDataFrame([(1, 10, 90), (1, 18, 91), (1, 18, 89), (1, 22, 92)], "g int, t int, rid int")
    got = {r.id: (r.rid, r.distance) for r in matching.nearest(left, right, ["g"], "t", "t", "id", "rid").collect()}
    assert got == {5: (90, 0), 6: (89, 2), 7: (89, 4)}


def test_gated_lookup_fails(spark):
    facts, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, name string")
    with pytest.raises(PySparkException, match="nobody"):
        matching.total_lookup(facts, dim, ["k"], "name", "nobody").collect()


def test_greedy_assignment(spark):
    c = spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 2, 1.0), (1, 2, 2, 1.5), (1, 2, 1, 9.0), (2, 1, 1, 3.0)], "page int, a_id int, b_id int, distance double")
    assert sorted(col(matching.greedy_assignment(c, ["page"]))) == [(1, 1, 2, 1.0), (1, 2, 1, 9.0), (2, 1, 1, 3.0)]


def test_text(spark):
    df = spark.createDataFrame([("São  Tomé​ & Príncipe", "DE LA CRUZ Ana", "120")], "a string, b string, c string")
    r = df.select(text.slug(text.ascii_fold("a")).alias("s"), text.clean(F.col("a")).alias("t"), text.player_slug(F.col("b"), F.lit("MEX")).alias("p"), text.ordinal_readings(F.col("c")).alias("o"), text.knockout_round(F.lit("Play-off for third place, Final day")).alias("k")).first()
    assert (r.s, r.t, r.p, r.k) == ("sao-tome-principe", "São Tomé & Príncipe", "de-la-cruz-ana-mex", "third-place")
    assert sorted(map(list, r.o)) == [[1, 20]]


def test_readings_as_a_table_function(spark):
    text.register_readings(spark)
    spark.createDataFrame([("120", 25), ("120", 15), ("12", 12), ("34", 14), ("7", 9), ("07", 9), ("x", 9), (None, 9), ("123456789", 99)], "d string, n int").createOrReplaceTempView("words")
    got = spark.sql("SELECT d, n, transform(parts, p -> p.ordinal) AS o, parts FROM words, LATERAL readings(d, n)").collect()
    assert sorted((r.d, r.n, r.o) for r in got) == [("12", 12, [1, 2]), ("12", 12, [12]), ("120", 25, [1, 20]), ("34", 14, [3, 4]), ("7", 9, [7])]
    assert [tuple(p) for r in got for p in r.parts if r.d == "120"] == [(0, 1, 1), (1, 3, 20)]


def test_numbers(spark):
    df = spark.createDataFrame([(2.675, "90+2'"), (0.125, "7'"), (2.5, "x")], "v double, m string")
    m, s = numbers.minute_stamp(F.col("m"))
    assert col(df.select(numbers.round_exact(2)("v"))) == [2.67, 0.12, 2.5]
    assert col(df.select(m.alias("m"), s.alias("s"))) == [(90, 2), (7, None), (None, None)]
    assert list(df.select(numbers.axis_ticks(F.lit(37.0), 4)).first()[0]) == [0.0, 10.0, 20.0, 30.0, 40.0]


def test_checks_and_cover(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.3), (3, None, 1.0)], "k int, a double, b double")
    r = checks.summarised([checks.check(df, "c", "k", F.col("a"), F.col("b"), 0.2)]).first()
    assert (r.passed, r.failed, r.not_applicable, r.result) == (1, 1, 1, "fail")
    rows = spark.createDataFrame([("b", "x", "1"), ("a", "x", "2"), ("c", "y", "2")], "id string, venue string, round string")
    cover = checks.set_cover(rows, "id", ["venue", "round"])
    told = {r.id: {("v", r.venue), ("r", r.round)} for r in rows.collect()}
    assert set().union(*(told[c] for c in cover)) == set().union(*told.values()) and len(cover) == len(set(cover))


def test_publish_swaps_all_or_none(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", 3)], "id int, name string, n int")
    target = tmp_path / "out"
    rows = publish.json_rows(df, "id")
    assert publish.write_artifacts(rows, str(target), "id", "json") == 2
    assert (target / "1.json").read_text() == '{\n  "id": 1,\n  "n": null,\n  "name": "é"\n}\n'
    bad = spark.createDataFrame([(1, "{"), (2, "{}")], "id int, json string")
    with pytest.raises(json.JSONDecodeError):
        publish.write_artifacts(bad, str(target), "id", "json")
    assert sorted(p.name for p in target.iterdir()) == ["1.json", "2.json"]
    size = len(gzip.compress((target / "1.json").read_text().encode(), 9, mtime=0))
    payload = spark.createDataFrame([(1, (target / "1.json").read_text())], "id int, t string")
    assert publish.over_budget(payload, "id", "t", size).count() == 0 and publish.over_budget(payload, "id", "t", size - 1).count() == 2


def test_records_fail_loudly(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    (tmp_path / "a.json").write_text('{"id": 1, "name": "x"}\n{"id": 2, "name": "y"}\n')
    records = tables.read_records(spark, str(tmp_path / "a.json"), schema, ["id"])
    kept = tables.records_in_manifest(records, spark.createDataFrame([(1, "extracted"), (2, "failed")], "id long, status string"), "id")
    assert col(kept) == [(1, "x")]
    (tmp_path / "b.json").write_text('{"name": "x"}\n')
    with pytest.raises(PySparkException, match="bad record"):
        tables.read_records(spark, str(tmp_path / "b.json"), schema, ["id"]).collect()
    assert tables.scan_files(spark, str(tmp_path), "*.json").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    ingest.run_available(ingest.windowed_counts(ingest.event_stream(spark, folder)), str(tmp_path / "o"), str(tmp_path / "c"))
    done = spark.read.parquet(str(tmp_path / "o"))
    batch = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp").alias("start"), "event_type", "n")
    assert done.count() > 0 and done.select("start", "event_type", "n").subtract(batch).count() == 0


FOLDER = "/root/testdata/sf0.001"


def test_panels_cover_all_orders(spark):
    prices = {}
    for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect():
        lo, hi = prices.get(r.p_partkey % 97, (r.p_retailprice, r.p_retailprice))
        prices[r.p_partkey % 97] = min(lo, r.p_retailprice), max(hi, r.p_retailprice)
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").collect()
    want = sorted((o.o_orderkey, p) for o in orders for p, (lo, hi) in prices.items() if lo <= o.o_totalprice / 100 < hi)
    assert any(k % 10 != 3 for k, _ in want)
    assert sorted(col(QUERIES["whole_range_panels"](spark, FOLDER))) == want


def test_close_labels_cover_all_pages(spark):
    points = [(r.vec_id, r.embedding[0] * 100, r.embedding[1] * 100) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = {(i, j) for i, x, y in points for j, u, v in points if i < j and i % 8 == j % 8 and math.hypot(x - u, y - v) <= 5.625}
    assert {i % 8 for i, _ in want} == set(range(8))
    got = [(r.marker, r.label) for r in QUERIES["whole_close_labels"](spark, FOLDER).collect()]
    assert len(got) == len(want) and set(got) == want


def test_table_positions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k) for k in range(60)]
    df = spark.createDataFrame(rows, "s string, id long")
    got = ranking.table_positions(df, {"up": F.col("key_").asc_nulls_last(), "down": F.col("key_").desc_nulls_last()}, "s", "id", width=7)
    rank = lambda order: {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (order[r[0]], r[1])), 1)}
    up, down = rank({"a": 0, "b": 1, None: 2}), rank({"b": 0, "a": 1, None: 2})
    assert sorted((r.id, r.up, r.down) for r in got.collect()) == [(k, up[k], down[k]) for k in range(60)]


def test_results_have_all_knockouts(spark):
    rows = QUERIES["whole_results_by_stage"](spark, FOLDER).orderBy("position").collect()
    assert {r.stage for r in rows} == {r.stage for r in QUERIES["match_rows"](spark, FOLDER).where("stage > 1").collect()} > {4, 5}
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.stage, r.match_id) for r in rows] == sorted((r.stage, r.match_id) for r in rows)


def test_stable_sort_covers_the_table(spark, tmp_path):
    rows = [(k, "AB"[k % 2]) for k in range(1, 20001)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    order = sorted(rows, key=lambda r: (r[1] if r[0] % 7 else "Z", r[0]))
    got = QUERIES["whole_stable_sort"](spark, str(tmp_path)).orderBy("up").collect()
    assert [(r.up, r.id) for r in got] == [(n, k) for n, (k, _) in enumerate(order, 1)]


def test_multisets_differ_both_ways(spark, tmp_path):
    rows = [(1, 1, "R"), (5000, 1, "R"), (6000, 1, "A"), (7000, 2, "A"), (7001, 2, "A"), (7002, 2, "R"), (8000, 3, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(col(QUERIES["whole_multiset_difference"](spark, str(tmp_path)))) == [(1, "R"), (2, "A")]


def test_linked_markers(spark):
    """A page a rule: swap by outcome, parts of a merged word, a duplicate ordinal, overlapping claims, a release that claims its word again, an ordinal without a row, a release that finds a part."""
    markers = [(1, 1, 0.0, "a"), (1, 2, 1.0, "b"), (2, 1, 0.0, "a"), (2, 2, 1.0, "a"), (3, 1, 0.0, "a"), (3, 2, 4.0, "a"), (4, 1, 0.0, "a"), (4, 2, 0.5, "a"), (5, 1, 0.0, "a"), (5, 2, 3.0, "a"), (6, 1, 0.0, "a"), (7, 1, 0.0, "a"), (7, 2, 3.0, "a")]
    glyphs = [  # page, glyph, x, ordinal, word, start, end, whole
        (1, 1, 0.9, 1, 1, 0, 1, True), (1, 2, 0.1, 2, 2, 0, 1, True),
        (2, 1, 0.2, 3, 1, 0, 1, False), (2, 2, 0.8, 4, 1, 1, 2, False),
        (3, 1, 0.0, 1, 1, 0, 1, True), (3, 2, 4.0, 1, 2, 0, 1, True),
        (4, 1, 0.2, 3, 1, 0, 2, True), (4, 2, 0.6, 4, 1, 1, 2, False),
        (5, 1, 0.0, 1, 1, 0, 1, True), (5, 2, 3.1, 1, 2, 0, 2, True), (5, 3, 3.2, 2, 2, 1, 2, False),
        (6, 1, 0.0, 9, 1, 0, 1, True),
        (7, 1, 0.0, 1, 1, 0, 1, True), (7, 2, 3.3, 1, 2, 0, 2, True), (7, 3, 3.2, 2, 2, 1, 2, False),
    ]
    rows = [(1, 1, ["a"]), (1, 2, ["b"]), (2, 3, ["a"]), (2, 4, ["a"]), (3, 1, ["a"]), (4, 3, ["a"]), (4, 4, ["a"]), (5, 1, ["a"]), (5, 2, ["a"]), (6, 1, ["a"]), (7, 1, ["a"]), (7, 2, ["a"])]
    m = spark.createDataFrame([(p, k, x, 0.0, o) for p, k, x, o in markers], "page int, marker int, ax double, ay double, outcome string")
    g = spark.createDataFrame([(p, k, x, 0.0, *r) for p, k, x, *r in glyphs], "page int, glyph int, bx double, by_ double, ordinal int, word int, start int, end int, whole boolean")
    r = spark.createDataFrame(rows, "page int, ordinal int, outcomes array<string>")
    got = {(x.page, x.marker): x.ordinal for x in matching.linked(m, g, r, ["page"], 5.625).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 3, (2, 2): 4, (3, 1): None, (3, 2): None, (4, 1): 3, (4, 2): None, (5, 1): None, (5, 2): None, (6, 1): None, (7, 1): 1, (7, 2): 2}


def test_every_marker_is_returned(spark):
    got = QUERIES["linked_markers"](spark, FOLDER).collect()
    assert sorted(r.marker for r in got) == [k for k in range(500) if k // 8 % 2 == 0]
    assert any(r.ordinal is None for r in got) and any(r.ordinal is not None for r in got)


def test_gates_fail(spark):
    """Each gate lets good rows through and fails with its message on bad ones."""
    import pytest
    from pyspark.sql import functions as F

    from tallymill.operators import gates

    good = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    bad = good.union(spark.createDataFrame([(2, "c")], "k int, v string"))
    assert {tuple(r) for r in gates.single_valued(good, ["k"], "v").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="several values"):
        gates.single_valued(bad, ["k"], "v").collect()
    left = spark.createDataFrame([(1,), (2,)], "k int")
    once = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "k int, w string")
    assert {tuple(r) for r in gates.exactly_one(left, once, ["k"], ["w"]).collect()} == {(1, "x"), (2, "y")}
    for wrong in (once.union(once.where("k = 1")), once.where("k <> 2")):
        with pytest.raises(Exception, match="exactly one match"):
            gates.exactly_one(left, wrong, ["k"], ["w"]).collect()
    minutes = lambda starter, on, off: spark.range(1).select(gates.minutes_played(F.lit(starter), F.lit(on).cast("int"), F.lit(off).cast("int"), F.lit(90)).alias("m")).first().m
    assert [minutes(True, None, None), minutes(True, None, 60), minutes(False, 60, None), minutes(False, None, None)] == [90, 60, 30, 0]
    for wrong in ((False, None, 70), (False, 80, 70)):
        with pytest.raises(Exception, match="contradict"):
            minutes(*wrong)
    at = lambda v: spark.range(1).select(gates.within(F.lit(v), 0.0, 100.0, 0.5, "outside").alias("v")).first().v
    assert [at(-0.4), at(50.0), at(100.5)] == [0.0, 50.0, 100.0]
    with pytest.raises(Exception, match="outside"):
        at(101.0)
    assert gates.same_columns(once, ["w", "k"]).columns == ["w", "k"]
    with pytest.raises(ValueError, match="undeclared"):
        gates.same_columns(once, ["k"])


def test_common_step_ignores_noise(spark):
    from tallymill.operators import sequence

    rows = [("a", 2.4 * k + n) for k, n in ((1, 0.0), (3, -0.004), (7, 0.003), (12, -0.002))] + [("b", v) for v in (10.0, 15.0, 35.0)]
    got = {r.g: r.unit for r in spark.createDataFrame(rows, "g string, v double").groupBy("g").agg(sequence.common_step("v").alias("unit")).collect()}
    assert abs(got["a"] - 2.4) < 0.02 and got["b"] == 5.0


def test_cover_has_no_bound(spark):
    from tallymill.operators import checks

    rows = spark.createDataFrame([(k, f"v{k}", None) for k in range(28)], "id int, a string, b string")
    assert checks.set_cover(rows, "id", ["a", "b"]) == list(range(28))


def test_spans_and_rounds(spark):
    rows = [("İstanbul licensed", 9), ("😀 License", 2), ("none", None), ("LICENSE", 0)]
    got = [r.s and (r.s.start, r.s.end) for r in spark.createDataFrame(rows, "t string, at int").select(text.match_span(F.col("t"), "license").alias("s")).collect()]
    assert got == [None if at is None else (at, at + 7) for _, at in rows]
    said = {"Round of 16": "round-of-16", "Match 16": None, "Round of 32": "round-of-32", "3rd place final": "third-place", "Quarter-finals": "quarter-final", "Semi-Final": "semi-final", "Final": "final", "Finalissima": None}
    rounds = spark.createDataFrame([(k,) for k in said], "t string").select("t", text.knockout_round(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rounds} == said
