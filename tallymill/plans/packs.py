"""Joins, sequences, sorts, sets, scalar functions and checks over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.functions import numbers, text
from tallymill.operators import anchors, checks, matching, sequence
from tallymill.operators.publish import json_rows, lost_pins
from tallymill.operators.ranking import table_positions, top_k
from tallymill.plans.facts import exact_sum, matches, player_match
from tallymill.plans.registry import GAMES, STATS, query
from tallymill.sources.tables import manifest_of_names, table
from tallymill.streaming.ingest import status_counts, to_process

# --- joins -----------------------------------------------------------------------------


@query("semi_records", "SELECT o_orderkey AS match_id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_records(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(kept, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderstatus").alias("status"))


@query("corroborated_lookup", """SELECT c_nationkey AS team, count(*) AS n, count(*) FILTER (n_name IS NOT NULL) AS by_key, count(*) FILTER (n_name = 'NATION_' || c_nationkey OR n_name IS NULL) AS agreed FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def corroborated_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by key whose name must agree."""
    facts = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("said"))
    found = matching.corroborated(facts, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), ["k"], "said", "n_name")
    return found.groupBy(F.col("k").alias("team")).agg(F.count("*").alias("n"), F.count_if("by_key").alias("by_key"), F.count_if(F.col("agrees") | ~F.col("by_key")).alias("agreed"))


@query("total_lookup", "SELECT s_suppkey AS player_id, n_name AS team_name, r_name AS group_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def total_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every fact must find its dimension row, else the query fails."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team_name"), "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("group_name"))
    one = matching.total_lookup(table(spark, d, "supplier"), n, ["s_nationkey"], "team_name", "player of no team")
    return matching.total_lookup(one, r, ["n_regionkey"], "group_name", "team of no group").select(F.col("s_suppkey").alias("player_id"), "team_name", "group_name")


@query("bijection_gaps", "SELECT coalesce(o_orderkey, k) AS id, CASE WHEN k IS NULL THEN 'a' ELSE 'b' END AS side FROM orders FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON k = o_orderkey WHERE k IS NULL OR o_orderkey IS NULL")
def bijection_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Ids that only one of two tables has."""
    return matching.symmetric_difference(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("lost_pins", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def pins(spark: SparkSession, d: str) -> DataFrame:
    return lost_pins(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query(
    "nearest_event",
    """WITH o AS (SELECT o_orderkey AS match_id, o_custkey % 20 AS g, floor(epoch(o_orderdate))::bigint % 86400 + o_orderkey % 86400 AS at FROM orders), e AS (SELECT event_id, user_id % 20 AS g, floor(epoch(ts))::bigint % 86400 AS at FROM events)
 SELECT match_id, event_id, distance FROM (SELECT match_id, event_id, abs(o.at - e.at) AS distance, row_number() OVER (PARTITION BY match_id ORDER BY abs(o.at - e.at), event_id) AS k FROM o JOIN e USING (g)) WHERE k = 1""",
)
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    """Each goal's nearest sample, ties to the lower id."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_custkey") % 20).alias("g"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) % 86400 + F.col("o_orderkey") % 86400).alias("at"))
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("g"), (F.unix_seconds(F.col("ts").cast("timestamp")) % 86400).alias("at"))
    return matching.nearest(o, e, ["g"], "at", "at", "match_id", "event_id").select("match_id", "event_id", "distance")


def _panels(spark: SparkSession, d: str, orders: DataFrame) -> DataFrame:
    p = table(spark, d, "part").groupBy((F.col("p_partkey") % 97).alias("panel")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    o = orders.select(F.col("o_orderkey").alias("match_id"), (F.col("o_totalprice") / 100).alias("x"))
    return matching.in_interval(o, "x", p, "lo", "hi", 100.0).select("match_id", "panel")


_PANELS_SQL = "WITH p AS (SELECT p_partkey % 97 AS panel, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1) SELECT o_orderkey AS match_id, panel::bigint AS panel FROM orders JOIN p ON o_totalprice / 100 >= lo AND o_totalprice / 100 < hi"


@query("range_panels", _PANELS_SQL)
@query("whole_range_panels", _PANELS_SQL)
def whole_range_panels(spark: SparkSession, d: str) -> DataFrame:
    """Titles assigned to the panels whose range holds their centre."""
    return _panels(spark, d, table(spark, d, "orders"))


_POINTS = "pts AS (SELECT vec_id AS id, vec_id % 8 AS page, embedding[1]::double * 100 AS x, embedding[2]::double * 100 AS y FROM embeddings)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 8).alias("page"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))


def _close(p: DataFrame) -> DataFrame:
    a, b = p.select("page", F.col("id").alias("marker"), F.col("x").alias("ax"), F.col("y").alias("ay")), p.select("page", F.col("id").alias("label"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    return matching.close_pairs(a, b, ["page"], 5.625).where("marker < label").select("marker", "label", F.lit(True).alias("near"))


_CLOSE_SQL = f"WITH {_POINTS} SELECT a.id AS marker, b.id AS label, true AS near FROM pts a JOIN pts b ON a.page = b.page AND a.id < b.id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5.625"


@query("close_labels", _CLOSE_SQL)
@query("whole_close_labels", _CLOSE_SQL)
def whole_close_labels(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of points of a page within the distance."""
    return _close(_points(spark, d))


@query("linked_markers")
def linked_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers and the ordinals of their labels; null where there is no link.

    On each page every other row is a marker, the rest are labels. Of three labels
    one is whole and two are the parts of a merged word; every eleventh repeats an
    ordinal. Rows of the table take one outcome by their ordinal, or both.
    """
    k = F.floor(F.col("id") / 16)
    outcome = lambda c: F.when(c % 2 == 0, "on-target").otherwise("incomplete")
    p = _points(spark, d).withColumns({"is_marker": F.floor(F.col("id") / 8) % 2 == 0, "k": k})
    markers = p.where("is_marker").select("page", F.col("id").alias("marker"), F.col("x").alias("ax"), F.col("y").alias("ay"), outcome(F.col("k")).alias("outcome"))
    part = F.col("k") % 3
    glyphs = p.where("not is_marker").select(
        "page", F.col("id").alias("glyph"), F.col("x").alias("bx"), F.col("y").alias("by_"), (F.col("k") - (F.col("k") % 11 == 10).cast("int") + 1).alias("ordinal"),
        F.when(part == 0, F.col("id")).otherwise(-F.floor(F.col("k") / 3) - 1).alias("word"), F.when(part == 2, 1).otherwise(0).alias("start"), F.when(part == 1, 1).otherwise(2).alias("end"), (part == 0).alias("whole"),
    )
    n = F.col("ordinal")
    rows = glyphs.select("page", "ordinal").distinct().select("page", "ordinal", F.when(n % 7 == 0, F.array(F.lit("incomplete"), F.lit("on-target"))).otherwise(F.array(outcome(n))).alias("outcomes"))
    return matching.linked(markers, glyphs, rows, ["page"], 5.625)


@query("edges_with_nodes", "WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL) SELECT src, dst, weight, s_name AS src_name, p_name AS dst_name FROM e JOIN supplier ON s_suppkey = src JOIN part ON p_partkey = dst")
def edges_with_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("weight"))
    s, p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("src_name")), table(spark, d, "part").select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("dst_name"))
    return e.join(s, "src").join(p, "dst").select("src", "dst", "weight", "src_name", "dst_name")


@query("optional_details", "SELECT d.doc_id, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def optional_details(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


# --- graph -----------------------------------------------------------------------------

_EDGES = "e AS (SELECT prev AS src, user_id AS dst, count(*) AS weight FROM (SELECT user_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL AND prev <> user_id GROUP BY ALL)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "ts", "event_id", F.col("user_id").alias("dst"))
    e = sequence.previous(e, ["event_type"], ["ts", "event_id"], "dst", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600), "src")
    return e.where("src is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query("node_degrees", f"WITH {_EDGES} SELECT node, count(DISTINCT far) AS degree, sum(weight)::bigint AS weight FROM (SELECT src AS node, dst AS far, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1")
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return matching.degrees(_edges(spark, d))


@query("incident_edges", f"WITH {_EDGES} SELECT src, dst, weight FROM e WHERE src = 7 OR dst = 7")
def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    return matching.incident(_edges(spark, d), F.lit(7))


@query("edge_domain", f"WITH {_EDGES} SELECT min(weight) AS lo, max(weight) AS hi, greatest(1, max(weight)) AS peak FROM e")
def edge_domain(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.greatest(F.lit(1), F.max("weight")).alias("peak"))


@query("centroids", f"WITH {_POINTS} SELECT page, sum(round(x * 1000)::bigint)::double / count(*) AS cx, sum(round(y * 1000)::bigint)::double / count(*) AS cy FROM pts GROUP BY 1")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    """Cluster centres in thousandths, so sums do not depend on order."""
    mid = lambda c: F.sum(F.round(F.col(c) * 1000).cast("bigint")).cast("double") / F.count("*")
    return _points(spark, d).groupBy("page").agg(mid("x").alias("cx"), mid("y").alias("cy"))


@query("approximate_unit")
def approximate_unit(spark: SparkSession, d: str) -> DataFrame:
    """The largest step that all quantities of a line number are near multiples of."""
    values = table(spark, d, "lineitem").select("l_linenumber", F.round("l_quantity", 6).alias("v")).distinct()
    return values.groupBy("l_linenumber").agg(sequence.common_step("v").alias("unit"))


# --- sequences -------------------------------------------------------------------------

_MINUTES = "ev AS (SELECT user_id % 40 AS g, event_id, (floor(value)::bigint % 125)::bigint AS minute FROM events)"


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 40).alias("g"), "event_id", (F.floor("value") % 125).cast("bigint").alias("minute"))


@query("shot_periods", f"""WITH {_MINUTES}, b AS (SELECT *, (minute > 45)::int + (minute > 90)::int + (minute > 105)::int AS b, coalesce((minute < lag(minute) OVER (PARTITION BY g ORDER BY event_id))::int, 0) AS back FROM ev),
 c AS (SELECT *, sum(back) OVER (PARTITION BY g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c FROM b) SELECT event_id, minute, greatest(0, c + min(b - c) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::bigint AS period FROM c""")
def shot_periods(spark: SparkSession, d: str) -> DataFrame:
    return sequence.periods(_minutes(spark, d), ["g"], ["event_id"], "minute", (45, 90, 105)).select("event_id", "minute", "period")


@query("clock_stamps", f"WITH {_MINUTES} SELECT event_id, least(minute, 90) AS minute, CASE WHEN minute > 90 THEN minute - 90 END AS stoppage, least(minute, 90) * 1000 + coalesce(CASE WHEN minute > 90 THEN minute - 90 END, 0) AS clock FROM ev")
def clock_stamps(spark: SparkSession, d: str) -> DataFrame:
    minute, stoppage = sequence.stamp(F.col("minute"), (90,))
    rows = _minutes(spark, d).select("event_id", minute.alias("m"), stoppage.alias("stoppage"))
    return rows.select("event_id", F.col("m").alias("minute"), "stoppage", numbers.clock_key(F.col("m"), F.col("stoppage")).alias("clock"))


@query("increasing_clock", "SELECT event_type, user_id % 5 AS g, bool_and(up) AS strictly_increasing FROM (SELECT event_type, user_id, coalesce(ts > lag(ts) OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id), true) AS up FROM events) GROUP BY ALL")
def increasing_clock(spark: SparkSession, d: str) -> DataFrame:
    return sequence.increases(table(spark, d, "events").withColumn("g", F.col("user_id") % 5), ["event_type", "g"], ["event_id"], "ts")


@query("visual_rows", f"""WITH RECURSIVE {_POINTS}, o AS (SELECT page, y, id, row_number() OVER (PARTITION BY page ORDER BY y, id) AS k FROM pts),
 r AS (SELECT page, y, id, k, y AS anchor, 1::bigint AS row FROM o WHERE k = 1 UNION ALL SELECT o.page, o.y, o.id, o.k, CASE WHEN o.y - r.anchor > 2.0 THEN o.y ELSE r.anchor END, r.row + (o.y - r.anchor > 2.0)::bigint FROM r JOIN o ON o.page = r.page AND o.k = r.k + 1)
 SELECT page, y, id, row FROM r""")
def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    return anchors.anchored_groups(_points(spark, d), ["page"], "y", "id", 2.0)


@query("joined_fragments", """SELECT conv_id, string_agg(CASE WHEN turn - prev > 1 OR (prev IS NOT NULL AND role = 'user') THEN ' ' ELSE '' END || left(role, 1), '' ORDER BY turn) AS joined FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1""")
def joined_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Turns as fragments; a user's turn starts two further on, so a space goes before it."""
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 2 + (F.col("role") == "user").cast("int")).cast("double").alias("x0"), F.left("role", F.lit(1)).alias("t"), F.col("turn"), F.col("role"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    gap = F.when(F.col("role") == "user", 2.0).otherwise(F.when(F.col("turn") - F.lag("turn").over(w) > 1, 2.0).otherwise(0.5))
    step = c.withColumn("gap", gap)
    placed = step.withColumn("x0", F.sum(F.col("gap") + 1.0).over(w)).withColumn("x1", F.col("x0") + 1.0)
    return sequence.joined_fragments(placed, ["conv_id"], "x0", "x1", "t", 1.0)


@query("running_appearances", f"""WITH {GAMES}, b AS (SELECT match_id, match_date, unnest([home, away]) AS team, home % 5 AS g FROM games) SELECT match_id, max(n)::bigint AS round FROM (SELECT match_id, row_number() OVER (PARTITION BY g, team ORDER BY match_date, match_id) AS n FROM b) GROUP BY 1""")
def running_appearances(spark: SparkSession, d: str) -> DataFrame:
    return sequence.appearances(matches(spark, d).withColumn("g", F.col("home") % 5), "g", ["match_date"])


@query("first_and_last_ticks", f"""WITH {_MINUTES}, k AS (SELECT g, event_id, minute, row_number() OVER (PARTITION BY g, minute ORDER BY event_id) = 1 AS f, event_id = max(event_id) OVER (PARTITION BY g) AS l FROM ev) SELECT g, event_id, minute FROM k WHERE f OR l""")
def first_and_last_ticks(spark: SparkSession, d: str) -> DataFrame:
    return sequence.first_and_last(_minutes(spark, d), ["g"], F.col("minute"), "event_id").select("g", "event_id", "minute")


@query("hit_half_widths", """WITH p AS (SELECT DISTINCT user_id % 40 AS g, floor(epoch(ts) / 600)::bigint AS place FROM events), q AS (SELECT g, place, place - lag(place) OVER (PARTITION BY g ORDER BY place) AS b, lead(place) OVER (PARTITION BY g ORDER BY place) - place AS a FROM p) SELECT g, place, least(22.0, coalesce(least(b, a), b, a, 44.0) / 2)::double AS half_width FROM q""")
def hit_half_widths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select((F.col("user_id") % 40).alias("g"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600).alias("place")).distinct()
    return sequence.half_gaps(p, ["g"], "place", 22.0).select("g", "place", F.col("half_width").cast("double").alias("half_width"))


@query("two_tone_collapse", """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'completed' ELSE 'attempted' END AS outcome, l_suppkey AS supp, l_partkey AS part FROM lineitem),
 m AS (SELECT *, count(*) OVER (PARTITION BY k, n) AS c, count(DISTINCT outcome) OVER (PARTITION BY k, n) AS o FROM p) SELECT k, n, outcome, supp, part FROM m WHERE NOT (c = 2 AND o = 2) OR outcome = 'completed'""")
def two_tone_collapse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", "completed").otherwise("attempted").alias("outcome"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"))
    return sequence.collapse_pairs(p, ["k", "n"], "outcome", "attempted", "completed")


@query("top5_zip", """WITH e AS (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity)::bigint AS v FROM lineitem GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v DESC, p) AS k FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p) AS k FROM e)
 SELECT a.s, a.k, a.p AS by_volume, b.p AS printed, a.v - b.v AS delta FROM a JOIN b USING (s, k) WHERE a.k <= 5""")
def top5_zip(spark: SparkSession, d: str) -> DataFrame:
    """The top five by volume beside another top five, place by place."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.sum("l_quantity").cast("bigint").alias("v"))
    a = top_k(e, ["s"], [F.desc("v"), F.col("p")], 5, "k").select("s", "k", F.col("p").alias("by_volume"), F.col("v").alias("va"))
    b = top_k(e, ["s"], [F.col("p")], 5, "k").select("s", "k", F.col("p").alias("printed"), F.col("v").alias("vb"))
    return a.join(b, ["s", "k"]).select("s", "k", "by_volume", "printed", (F.col("va") - F.col("vb")).alias("delta"))


# --- sorts and limits ------------------------------------------------------------------


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("s"))


_SORT_SQL = "WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS s FROM customer) SELECT id, s, row_number() OVER (ORDER BY s ASC NULLS LAST, id) AS up, row_number() OVER (ORDER BY s DESC NULLS LAST, id) AS down FROM t"


@query("stable_sort_nulls_last", _SORT_SQL)
@query("whole_stable_sort", _SORT_SQL)
def whole_stable_sort(spark: SparkSession, d: str) -> DataFrame:
    """Nulls last in both directions, ties in input order, over the whole table."""
    return table_positions(_segments(spark, d), {"up": F.col("key_").asc_nulls_last(), "down": F.col("key_").desc_nulls_last()}, "s", "id")


@query("events_in_clock_order", f"WITH {_MINUTES}, n AS (SELECT g, event_id, nullif(minute % 11, 0) AS minute, minute % 3 AS stoppage FROM ev) SELECT g, event_id, row_number() OVER (PARTITION BY g ORDER BY minute ASC NULLS LAST, stoppage, event_id) AS position FROM n")
def clock_order(spark: SparkSession, d: str) -> DataFrame:
    n = _minutes(spark, d).select("g", "event_id", F.nullif(F.col("minute") % 11, F.lit(0)).alias("m"), (F.col("minute") % 3).alias("stoppage"))
    return n.select("g", "event_id", F.row_number().over(Window.partitionBy("g").orderBy(F.col("m").asc_nulls_last(), "stoppage", "event_id")).cast("bigint").alias("position"))


@query("search", "WITH c AS (SELECT 0 AS kind, n_nationkey::bigint AS id, n_name AS name FROM nation UNION ALL SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 2, p_partkey, p_name FROM part) SELECT kind, id, name FROM c WHERE contains(lower(name), 'nation') OR contains(lower(name), 'a') ORDER BY CASE WHEN starts_with(lower(name), 'a') THEN 0 ELSE 1 END, kind, id LIMIT 10")
def search(spark: SparkSession, d: str) -> DataFrame:
    """Prefix hits first, then other hits, each in corpus order; ten rows. The limit is the feature."""
    row = lambda t, k, i, n: table(spark, d, t).select(F.lit(k).alias("kind"), F.col(i).cast("bigint").alias("id"), F.col(n).alias("name"))
    c = row("nation", 0, "n_nationkey", "n_name").unionByName(row("supplier", 1, "s_suppkey", "s_name")).unionByName(row("part", 2, "p_partkey", "p_name"))
    low = F.lower("name")
    return c.where(low.contains("a")).orderBy(F.when(low.startswith("a"), 0).otherwise(1), "kind", "id").limit(10)


@query("folded_filter", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '00007') OR contains(lower(c_mktsegment), 'auto')")
def folded_filter(spark: SparkSession, d: str) -> DataFrame:
    """Substring filter without regard to case or accents, on the entity or its team."""
    hit = lambda c, q: F.contains(F.collate(F.col(c), "UNICODE_CI_AI"), F.collate(F.lit(q), "UNICODE_CI_AI"))
    return table(spark, d, "customer").where(hit("c_name", "00007") | hit("c_mktsegment", "AUTO")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


# --- sets ------------------------------------------------------------------------------


@query("duplicates", "SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.count("*").alias("copies")).where("copies > 1")


_DIFFERENCE_SQL = """WITH r AS (SELECT l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT l_linenumber AS n FROM lineitem WHERE l_returnflag = 'A')
 SELECT n, 'R' AS side FROM (SELECT n FROM r EXCEPT ALL SELECT n FROM a) UNION ALL SELECT n, 'A' FROM (SELECT n FROM a EXCEPT ALL SELECT n FROM r)"""


@query("multiset_difference", _DIFFERENCE_SQL)
@query("whole_multiset_difference", _DIFFERENCE_SQL)
def whole_multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    """What either multiset has beyond the other, with its side; none where they are equal."""
    side = lambda f: table(spark, d, "lineitem").where(f"l_returnflag = '{f}'").select(F.col("l_linenumber").alias("n"))
    return side("R").exceptAll(side("A")).withColumn("side", F.lit("R")).unionByName(side("A").exceptAll(side("R")).withColumn("side", F.lit("A")))


@query("set_overlap", "SELECT c_nationkey AS team FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("team")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("sample_cover")
def sample_cover(spark: SparkSession, d: str) -> DataFrame:
    """A few orders that cover every status and priority."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    chosen = checks.set_cover(o, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return o.where(F.col("o_orderkey").isin(chosen))


# --- aggregates with zeros and nulls ---------------------------------------------------


@query("status_counts", "SELECT s AS status, count(o_orderstatus) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def counts_by_status(spark: SparkSession, d: str) -> DataFrame:
    return status_counts(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ["F", "O", "P", "X"])


@query("deviation_counts", "SELECT coalesce(CASE WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'good' END, '(unknown)') AS category, coalesce(lang, '(unknown)') AS venue, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def deviation_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    category = F.coalesce(F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good"), F.lit("(unknown)"))
    return rows.groupBy(category.alias("category"), F.coalesce("lang", F.lit("(unknown)")).alias("venue")).agg(F.count("*").alias("n"))


@query("offer_shares", "SELECT l_suppkey AS player_id, count(*) FILTER (l_returnflag = 'R') AS received, count(*) FILTER (l_returnflag <> 'N') AS offered, count(*) FILTER (l_returnflag = 'R') * 100.0::double / nullif(count(*) FILTER (l_returnflag <> 'N'), 0)::double AS share, coalesce(count(*) FILTER (l_returnflag = 'R') * 100.0::double / nullif(count(*) FILTER (l_returnflag <> 'N'), 0)::double, 0) AS share_or_zero FROM lineitem GROUP BY 1")
def offer_shares(spark: SparkSession, d: str) -> DataFrame:
    """A share that is null, and one that is zero, where nothing was offered."""
    r, o = F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_returnflag") != "N")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("player_id")).agg(r.alias("received"), o.alias("offered"), numbers.share(r, o).alias("share"), numbers.share(r, o, 0.0).alias("share_or_zero"))


@query("movement_split", f"WITH m AS (SELECT s AS kind FROM (VALUES ('AIR'), ('A'), ('N'), ('R')) v(s)), c AS (SELECT l_suppkey AS team, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT DISTINCT team FROM c) SELECT t.team, m.kind, coalesce(n, 0) AS n, coalesce(n, 0) * 100.0::double / sum(coalesce(n, 0)) OVER (PARTITION BY t.team) AS share, coalesce(n, 0) = 0 AS is_zero FROM t CROSS JOIN m LEFT JOIN c ON c.team = t.team AND c.kind = m.kind")
def movement_split(spark: SparkSession, d: str) -> DataFrame:
    """All kinds for each team, zero where none."""
    kinds = ["AIR", "A", "N", "R"]
    wide = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("team")).agg(*(F.count_if(F.col("l_returnflag") == k).alias(k) for k in kinds))
    long = wide.unpivot(["team"], kinds, "kind", "n")
    return long.withColumn("share", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy("team"))).withColumn("is_zero", F.col("n") == 0)


@query("figure_counts", "SELECT l_suppkey AS team, count(*) AS shots, count(*) FILTER (l_returnflag = 'R') AS goals, count(*) FILTER (l_discount IS NOT NULL AND l_discount > 0) AS rated, bool_or(l_tax > 0.07) AS any_high FROM lineitem WHERE l_linestatus <> 'X' GROUP BY 1")
def figure_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_linestatus <> 'X'").groupBy(F.col("l_suppkey").alias("team")).agg(F.count("*").alias("shots"), F.count_if(F.col("l_returnflag") == "R").alias("goals"), F.count_if(F.col("l_discount") > 0).alias("rated"), F.bool_or(F.col("l_tax") > 0.07).alias("any_high"))


@query("legend_rows", "SELECT l_suppkey AS page, round(l_quantity, 1) AS y, count(DISTINCT l_returnflag) AS colors FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) >= 3")
def legend_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows on which enough colours meet are a legend."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("page"), F.round("l_quantity", 1).alias("y")).agg(F.count_distinct("l_returnflag").alias("colors")).where("colors >= 3")


@query("markers_without_legend", "WITH g AS (SELECT l_suppkey AS page, round(l_quantity, 1) AS y FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) >= 3) SELECT l_suppkey AS page, count(*) AS markers FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page = l_suppkey AND g.y = round(l_quantity, 1)) GROUP BY 1")
def markers_without_legend(spark: SparkSession, d: str) -> DataFrame:
    """Markers that are on no legend row."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.round("l_quantity", 1).alias("y"))
    return rows.join(legend_rows(spark, d).select("page", "y"), ["page", "y"], "left_anti").groupBy("page").agg(F.count("*").alias("markers"))


# --- scalar functions ------------------------------------------------------------------


@query("slugs", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("match_spans", "SELECT doc_id, nullif(strpos(lower(text), 'license'), 0) - 1 AS start, nullif(strpos(lower(text), 'license'), 0) + 6 AS end_ FROM documents WHERE strpos(lower(text), 'license') > 0")
def match_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", text.match_span(F.col("text"), "license").alias("s")).where("s is not null")
    return s.select("doc_id", "s.start", F.col("s.end").alias("end_"))


@query("page_anchors", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, strpos(html, '<nav>') > 0 AS has_nav, starts_with(html, '<!DOCTYPE') AS has_type, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_length FROM pages")
def page_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and text of pages."""
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), html.contains("<nav>").alias("has_nav"), html.startswith("<!DOCTYPE").alias("has_type"), F.length(F.regexp_replace(html, "<[^>]+>", "")).cast("bigint").alias("text_length"))


@query("shootouts", "WITH t AS (SELECT o_orderkey AS k, '1-1 (' || o_clerk || ' win ' || (o_orderkey % 5 + 1) || '-' || (o_orderkey % 5) || ' on Penalties)' AS s FROM (SELECT o_orderkey, o_orderpriority AS o_clerk FROM orders)) SELECT k, regexp_extract(s, '\\((.+?) win (\\d+)-(\\d+) on [Pp]enalties\\)', 1) AS winner, regexp_extract(s, '\\((.+?) win (\\d+)-(\\d+) on [Pp]enalties\\)', 2)::bigint AS a, regexp_extract(s, '\\((.+?) win (\\d+)-(\\d+) on [Pp]enalties\\)', 3)::bigint AS b FROM t")
def shootouts(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("1-1 ("), F.col("o_orderpriority"), F.lit(" win "), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit("-"), (F.col("o_orderkey") % 5).cast("string"), F.lit(" on Penalties)"))
    w, a, b = text.shootout(said)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), w.alias("winner"), a.alias("a"), b.alias("b"))


@query("leaders", f"WITH {GAMES} SELECT match_id, CASE WHEN home_goals = away_goals THEN 'tie' WHEN home_goals > away_goals THEN 'home' ELSE 'away' END AS higher, CASE WHEN home_goals = away_goals THEN 'tie' WHEN home_goals < away_goals THEN 'home' ELSE 'away' END AS lower FROM games")
def leaders(spark: SparkSession, d: str) -> DataFrame:
    h, a = F.col("home_goals"), F.col("away_goals")
    return matches(spark, d).select("match_id", numbers.leader(h, a).alias("higher"), numbers.leader(h, a, "lower").alias("lower"))


@query("axis_steps", "WITH t AS (SELECT p_partkey AS id, p_size::double AS top, p_size::double / 5 AS raw FROM part), u AS (SELECT *, pow(10.0, floor(log10(raw))) AS unit FROM t) SELECT id, (CASE WHEN round(raw / unit, 9) <= 1 THEN 1.0 WHEN round(raw / unit, 9) <= 2 THEN 2.0 WHEN round(raw / unit, 9) <= 5 THEN 5.0 ELSE 10.0 END)::double * unit AS step FROM u")
def axis_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numbers.nice_step(F.col("p_size").cast("double"), 5).alias("step"))


@query("pitch_points", f"WITH {_POINTS}, q AS (SELECT id, 100 * (50.0 - y) / 100.0 AS a, 100 * (x - -50.0) / 100.0 AS b FROM pts) SELECT id, CASE WHEN a BETWEEN -0.5 AND 100.5 THEN least(100.0, greatest(0.0, a)) END AS px, CASE WHEN b BETWEEN -0.5 AND 100.5 THEN least(100.0, greatest(0.0, b)) END AS py FROM q")
def pitch_points(spark: SparkSession, d: str) -> DataFrame:
    x, y = numbers.to_pitch(F.col("x"), F.col("y"), F.lit(-50.0), F.lit(-50.0), F.lit(50.0), F.lit(50.0))
    return _points(spark, d).select("id", x.alias("px"), y.alias("py"))


@query("minutes_played", f"WITH {_MINUTES} SELECT event_id, greatest(0, coalesce(CASE WHEN event_id % 3 = 0 THEN 90 END, 120) - coalesce(CASE WHEN event_id % 2 = 0 THEN minute END, 0))::bigint AS minutes FROM ev")
def played(spark: SparkSession, d: str) -> DataFrame:
    on, off = F.when(F.col("event_id") % 2 == 0, F.col("minute")), F.when(F.col("event_id") % 3 == 0, F.lit(90))
    return _minutes(spark, d).select("event_id", numbers.minutes_played(on, off, F.lit(120)).cast("bigint").alias("minutes"))


@query("rounded_values", "SELECT s_suppkey AS player_id, round_even(s_acctbal::decimal(30,10), 1)::double AS balance FROM supplier")
def rounded_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("player_id"), numbers.round_decimal(F.col("s_acctbal"), 1).alias("balance"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("event_properties", "SELECT event_type, count(*) AS n, count(DISTINCT length(props)) AS shapes FROM events GROUP BY 1")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.length("props")).alias("shapes"))


@query("canonical_rows")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    return json_rows(table(spark, d, "supplier"), "s_suppkey")


@query("manifest", "SELECT DISTINCT s_suppkey AS number, 'A' || (s_nationkey % 10) AS home, 'B' || (s_suppkey % 10) AS away, 'M' || s_suppkey || ' a' || (s_nationkey % 10) || ' v b' || (s_suppkey % 10) AS name FROM supplier")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("M"), F.col("s_suppkey").cast("string"), F.lit(" a"), (F.col("s_nationkey") % 10).cast("string"), F.lit(" v b"), (F.col("s_suppkey") % 10).cast("string"))
    return manifest_of_names(table(spark, d, "supplier").select(name.alias("n")), "n").select("number", "home", "away", "name")


# --- checks and ingest -----------------------------------------------------------------

_CHECKS = """c AS (SELECT 'characters' AS "check", n_chars::double AS p, length(text)::double AS q, 0.0 AS tol FROM documents
 UNION ALL SELECT 'dense-turns', max(turn)::double - min(turn) + 1, count(DISTINCT turn)::double, 0.0 FROM conversations GROUP BY conv_id
 UNION ALL SELECT 'order-total', max(o_totalprice)::double, sum(l_extendedprice::decimal(18,4))::double, 1.0 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
 UNION ALL SELECT 'label-has-document', 1.0, CASE WHEN d.doc_id IS NULL THEN 0.0 ELSE 1.0 END, 0.0 FROM labels l LEFT JOIN documents d USING (doc_id)
 UNION ALL SELECT 'quality-known', quality::double, quality::double, 0.0 FROM documents LEFT JOIN labels USING (doc_id))"""


@query("reconciliation", f"""WITH {_CHECKS}, r AS (SELECT "check", abs(p - q) AS delta, CASE WHEN p IS NULL OR q IS NULL THEN 'not-applicable' WHEN abs(p - q) <= tol THEN 'pass' ELSE 'fail' END AS result FROM c)
 SELECT "check", count(*) FILTER (result = 'pass') AS passed, count(*) FILTER (result = 'fail') AS failed, count(*) FILTER (result = 'not-applicable') AS not_applicable, max(delta) AS max_delta,
 CASE WHEN count(*) FILTER (result = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (result = 'pass') > 0 THEN 'pass' ELSE 'not-applicable' END AS result FROM r GROUP BY 1""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Checks that pass, one that fails by the data's making, and one that often does not apply."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    turns = table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("n"))
    totals = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.max("o_totalprice").alias("told"), exact_sum("l_extendedprice").alias("summed"))
    found = labels.join(docs.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    known = docs.select("doc_id").join(labels, "doc_id", "left")
    return checks.summarised([
        checks.check(docs, "characters", "doc_id", F.col("n_chars"), F.length("text")), checks.check(turns, "dense-turns", "conv_id", F.col("span"), F.col("n")),
        checks.check(totals, "order-total", "o_orderkey", F.col("told"), F.col("summed"), 1.0), checks.check(found, "label-has-document", "doc_id", F.lit(1), F.coalesce("hit", F.lit(0))),
        checks.check(known, "quality-known", "doc_id", F.col("quality"), F.col("quality")),
    ])


@query("incremental_rows", "SELECT doc_id FROM documents WHERE NOT (doc_id % 3 = 0)")
def incremental_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a manifest of every third one does not cover."""
    now = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit("v1").alias("code_version"))
    return to_process(now, now.where("doc_id % 3 = 0"), "doc_id").select("doc_id")


@query("player_match_rows", f"WITH {STATS} SELECT match_id, player_id, quantity, revenue, discount, tax, lines FROM stats")
def player_match_rows(spark: SparkSession, d: str) -> DataFrame:
    return player_match(spark, d)


@query("match_rows", f"WITH {GAMES} SELECT * FROM games")
def match_rows(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d)


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(round(value * 10000)::bigint)::bigint AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("bigint")).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
