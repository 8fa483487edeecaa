"""Scores at the limits of matches, all player metrics, stamps of periods, page order and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.functions import text
from tallymill.operators import scores, sequence
from tallymill.operators.matching import total_lookup
from tallymill.plans.facts import player_match
from tallymill.plans.registry import STATS, query
from tallymill.sources.tables import table

# A goal is an order's returned (home) or accepted (away) line; line n falls in minute 17 n.
# The cover's score is the order's own count of flags; the clock is its highest line number,
# so a match with a sixth line went to extra time; a level one then has a shoot-out line.
_COVERS = """l AS (SELECT l_orderkey AS match_id, l_linenumber AS n, l_returnflag AS f FROM lineitem),
 c AS (SELECT match_id, count(*) FILTER (f = 'R') AS h, count(*) FILTER (f = 'A') AS a, max(n) > 5 AS et, count(*) FILTER (f = 'R' AND n <= 5) AS h90, count(*) FILTER (f = 'A' AND n <= 5) AS a90 FROM l GROUP BY 1)"""


@query(
    "decided_or_fail",
    f"""WITH {_COVERS}, s AS (SELECT *, et AND h = a AS so, match_id % 2 = 0 AS hw FROM c) SELECT match_id, h90 AS home_90, a90 AS away_90, CASE WHEN et THEN h END AS home_et, CASE WHEN et THEN a END AS away_et,
 CASE WHEN so THEN CASE WHEN hw THEN 4 ELSE 3 END END::bigint AS home_shootout, CASE WHEN so THEN CASE WHEN hw THEN 3 ELSE 5 END END::bigint AS away_shootout,
 CASE WHEN so THEN CASE WHEN hw THEN 'H' ELSE 'A' END || match_id WHEN h > a THEN 'H' || match_id WHEN h < a THEN 'A' || match_id END AS winner,
 CASE WHEN so THEN 'shootout' WHEN et THEN 'extra-time' ELSE 'regulation' END AS decided_by FROM s""",
)
def decided_or_fail(spark: SparkSession, d: str) -> DataFrame:
    """Each match's scores, shoot-out, winner and how it was decided; contradictions fail."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id"), (F.col("l_linenumber") * 17).alias("minute"), F.col("l_returnflag").alias("flag"))
    goals = lines.where("flag in ('R', 'A')").select("match_id", "minute", (F.col("flag") == "R").alias("for_home"))
    covers = lines.groupBy("match_id").agg(F.count_if(F.col("flag") == "R").alias("home_score"), F.count_if(F.col("flag") == "A").alias("away_score"), (F.max("minute") > 90).alias("extra_time"))
    name = lambda side: F.concat(F.lit(side), F.col("match_id").cast("string"))
    line = F.concat(F.lit("("), F.when(F.col("match_id") % 2 == 0, F.concat(name("H"), F.lit(" win 4-3"))).otherwise(F.concat(name("A"), F.lit(" win 3-5"))), F.lit(" on Penalties)"))
    covers = covers.select("*", name("H").alias("home"), name("A").alias("away"), F.when(F.col("extra_time") & (F.col("home_score") == F.col("away_score")), line).alias("shootout"))
    return scores.decided(covers, goals)


#: The metrics of a player, how each is aggregated, whether it has a rate for 90 minutes.
PLAYER_METRICS = (
    ("ballProgressions", "sum", True), ("crossesCompleted", "sum", True), ("duelsWonAerial", "sum", True), ("duelsWonPhysical", "sum", True), ("goals", "sum", True), ("highSpeedRuns", "sum", True),
    ("interceptions", "sum", True), ("lineBreaksCompleted", "sum", True), ("passCompletion", "average", False), ("passesCompleted", "sum", True), ("possessionRegains", "sum", True), ("sprints", "sum", True),
    ("stepIns", "sum", True), ("switchesOfPlay", "sum", True), ("tacklesWon", "sum", True), ("takeOns", "sum", True), ("topSpeed", "max", False), ("totalDistance", "sum", True),
)
#: The physical totals beside the top speed.
PHYSICAL = ("totalDistance", "distanceZone1", "distanceZone2", "distanceZone3", "distanceZone4", "distanceZone5", "highSpeedRuns", "sprints")
#: A player's figures of a match, from one line; both engines read these expressions.
_FIGURES = {
    "ballProgressions": "l_partkey % 7", "crossesCompleted": "l_partkey % 3", "duelsWonAerial": "l_orderkey % 4", "duelsWonPhysical": "l_orderkey % 5", "goals": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "highSpeedRuns": "l_partkey % 11", "interceptions": "l_orderkey % 3", "lineBreaksCompleted": "l_partkey % 9", "passesCompleted": "l_quantity * (1 - l_discount)", "possessionRegains": "l_orderkey % 7", "sprints": "l_partkey % 13",
    "stepIns": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END", "switchesOfPlay": "l_partkey % 2", "tacklesWon": "l_orderkey % 6", "takeOns": "CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END", "topSpeed": "l_tax * 100", "totalDistance": "l_extendedprice",
    "distanceZone1": "l_extendedprice * 0.4", "distanceZone2": "l_extendedprice * 0.3", "distanceZone3": "l_extendedprice * 0.15", "distanceZone4": "l_extendedprice * 0.1", "distanceZone5": "l_extendedprice * 0.05",
}
# The first three lines of a match are starters; others come on in minute 60, but each seventh never; every other player goes off in minute 80.
_FIELD = "l_linenumber <= 3 OR l_linenumber < 7"
_SPENT = "CASE WHEN l_partkey % 2 = 0 THEN 80 ELSE 90 END - CASE WHEN l_linenumber <= 3 THEN 0 ELSE 60 END"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A row a player and line of those who took the field."""
    n, even = F.col("l_linenumber"), F.col("l_partkey") % 2 == 0
    on = F.when((n > 3) & (n < 7), F.lit(60))
    off = F.when(even & ((n <= 3) | on.isNotNull()), F.lit(80))
    played = table(spark, d, "lineitem").where(scores.took_the_field(n <= 3, on, off))
    minutes = F.coalesce(off, F.lit(90)) - F.coalesce(on, F.lit(0))
    return played.select(F.col("l_suppkey").alias("player_id"), F.col("l_quantity").alias("passes"), minutes.alias("minutes"), *(F.expr(e).alias(m) for m, e in _FIGURES.items()))


def _aggregate_sql() -> str:
    of = {m: f"coalesce({how}(({_FIGURES[m]})::{'double' if how == 'max' else 'decimal(28,4)'})::double, 0.0)" for m, how, _ in PLAYER_METRICS if how != "average"}
    of["passCompletion"] = f"coalesce(sum(({_FIGURES['passesCompleted']})::decimal(28,4))::double / nullif(sum(l_quantity::decimal(28,4))::double, 0) * 100, 0.0)"
    parts = " UNION ALL ".join(
        f"SELECT s_suppkey AS player_id, '{m}' AS metric, '{how}' AS aggregation, coalesce(\"{m}\", 0.0) AS value, {f'CASE WHEN minutes > 0 THEN coalesce(\"{m}\", 0.0) / minutes * 90 END' if rate else 'NULL::double'} AS per_ninety FROM supplier LEFT JOIN t ON player_id = s_suppkey"
        for m, how, rate in PLAYER_METRICS
    )
    return f"WITH t AS (SELECT l_suppkey AS player_id, sum({_SPENT})::bigint AS minutes, {', '.join(f'{e} AS \"{m}\"' for m, e in of.items())} FROM lineitem WHERE {_FIELD} GROUP BY 1) {parts}"


@query("player_aggregates", _aggregate_sql())
def player_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """All 18 metrics of every player, zeros where there was no appearance."""
    players = table(spark, d, "supplier").select(F.col("s_suppkey").alias("player_id"))
    return scores.player_metrics(players, _records(spark, d), "player_id", PLAYER_METRICS, "minutes", ("passCompletion", "passesCompleted", "passes"))


@query(
    "physical_profiles",
    f"""WITH t AS (SELECT l_suppkey AS player_id, {', '.join(f'sum(({_FIGURES[m]})::decimal(28,4))::double AS "{m}"' for m in PHYSICAL)}, max(({_FIGURES['topSpeed']})::double) AS "topSpeed" FROM lineitem WHERE {_FIELD} GROUP BY 1)
 SELECT s_suppkey AS player_id, {', '.join(f'coalesce("{m}", 0.0) AS "{m}"' for m in (*PHYSICAL, 'topSpeed'))} FROM supplier LEFT JOIN t ON player_id = s_suppkey""",
)
def physical_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Eight sums and the top speed over the matches in which a player took the field."""
    totals = _records(spark, d).groupBy("player_id").agg(*(F.sum(F.col(m).cast("decimal(28,4)")).cast("double").alias(m) for m in PHYSICAL), F.max(F.col("topSpeed").cast("double")).alias("topSpeed"))
    players = table(spark, d, "supplier").select(F.col("s_suppkey").alias("player_id"))
    return players.join(totals, "player_id", "left").fillna(0.0, [*PHYSICAL, "topSpeed"])


@query(
    "shot_stamps",
    """WITH e AS (SELECT event_id, (event_id % 4)::int AS period, (floor(abs(value))::bigint % 60) + [0, 45, 90, 105][event_id % 4 + 1] AS raw FROM events), b AS (SELECT *, [45, 90, 105, 120][period + 1] AS bound FROM e)
 SELECT event_id, least(raw + 1, bound)::bigint AS minute, CASE WHEN raw + 1 > bound THEN raw + 1 - bound END::bigint AS stoppage FROM b""",
)
def shot_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of printed elapsed minutes, which are one below the minute of play; what passes
    the end of the shot's period is stoppage of that period."""
    period = (F.col("event_id") % 4).cast("int")
    raw = F.floor(F.abs("value")) % 60 + F.element_at(F.array(*map(F.lit, (0, 45, 90, 105))), period + 1)
    minute, stoppage = sequence.stamp(raw + 1, period=period)
    return table(spark, d, "events").select("event_id", minute.cast("bigint").alias("minute"), stoppage.cast("bigint").alias("stoppage"))


@query(
    "shots_in_page_order",
    """SELECT vec_id, team, page, row_number() OVER (PARTITION BY team, page ORDER BY y, x, vec_id) AS position FROM (SELECT vec_id, label AS team, vec_id // 64 AS page, round(embedding[2]::double * 100, 2) AS y, round(embedding[1]::double * 100, 2) AS x FROM embeddings)""",
)
def shots_in_page_order(spark: SparkSession, d: str) -> DataFrame:
    """Shots of a team from page to page, each page from its top, in places of two decimals."""
    at = lambda k: F.round(F.col("embedding")[k].cast("double") * 100, 2)
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("team"), F.floor(F.col("vec_id") / 64).alias("page"), at(1).alias("y"), at(0).alias("x"))
    return e.select("vec_id", "team", "page", F.row_number().over(Window.partitionBy("team", "page").orderBy("y", "x", "vec_id")).cast("bigint").alias("position"))


@query(
    "term_spans",
    r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?is)^(.*?)(?:^|[^\p{L}\p{N}])model', 0) AS head FROM documents), s AS (SELECT doc_id, text, length(head) - 5 AS start FROM t WHERE head <> '')
 SELECT doc_id, start::bigint AS start, (start + length(regexp_extract(substr(text, start + 1), '(?i)^model[\p{L}\p{N}]*', 0)))::bigint AS end_ FROM s""",
)
def term_spans(spark: SparkSession, d: str) -> DataFrame:
    """First place of a term that begins a word, up to the word's end."""
    s = table(spark, d, "documents").select("doc_id", text.term_span(F.col("text"), "model").alias("s")).where("s is not null")
    return s.select("doc_id", "s.start", F.col("s.end").alias("end_"))


@query(
    "player_trend_or_fail",
    f"""WITH {STATS} SELECT player_id, match_id, o_orderdate::date AS match_date, row_number() OVER (PARTITION BY player_id ORDER BY o_orderdate::date, match_id) AS appearance, quantity AS value FROM stats LEFT JOIN orders ON o_orderkey = match_id""",
)
def player_trend_or_fail(spark: SparkSession, d: str) -> DataFrame:
    """A player's values in order of date; a value of no known match fails."""
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("match_date"))
    rows = total_lookup(player_match(spark, d), known, ["match_id"], "match_date", "a trend point of no match")
    return rows.select("player_id", "match_id", "match_date", F.row_number().over(Window.partitionBy("player_id").orderBy("match_date", "match_id")).cast("bigint").alias("appearance"), F.col("quantity").alias("value"))
