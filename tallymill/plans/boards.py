"""Leaderboards, standings, records and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.operators.ranking import band_of, cap_with_ties, competition_rank, quantile_thresholds, table_positions, total_rank
from tallymill.plans.facts import METRICS, exact_avg, exact_sum, matches, player_match, sides, unpivoted
from tallymill.plans.registry import GAMES, LONG, SIDES, STATS, query
from tallymill.sources.tables import table

CAP = 100
#: Board number, metric, scope, aggregation, whether high values lead.
BOARDS = [
    (k, metric, scope, aggregation, higher)
    for k, (metric, scope, aggregation, higher) in enumerate(
        [(m, s, a, not (m == "tax" and a == "average")) for s in ("team", "player") for m in METRICS for a in ("sum", "average", "max")]
    )
]
_BOARD_VALUES = ", ".join(f"({k}, '{m}', '{s}', '{a}', {str(h).lower()})" for k, m, s, a, h in BOARDS)


def board_rows(spark: SparkSession, d: str) -> DataFrame:
    """All boards at once: one aggregation of the long facts for players and one
    for teams, then a join with the small table of boards."""
    facts = player_match(spark, d).drop("lines")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("player_id"), "s_name", F.col("s_nationkey").alias("team_id"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"), "n_name")
    named = facts.join(supplier, "player_id").join(nation, "team_id")
    team_match = named.groupBy("match_id", F.col("team_id").cast("bigint").alias("entity_id"), F.col("n_name").alias("entity_name"), F.col("n_name").alias("team_name")).agg(*(exact_sum(m).alias(m) for m in METRICS))
    players = named.select("match_id", F.col("player_id").alias("entity_id"), F.col("s_name").alias("entity_name"), F.col("n_name").alias("team_name"), *METRICS)
    keys = ["match_id", "entity_id", "entity_name", "team_name"]

    def totals(frame: DataFrame, scope: str) -> DataFrame:
        long = unpivoted(frame.select(*keys, *METRICS), keys, METRICS)
        return long.groupBy("metric", "entity_id", "entity_name", "team_name").agg(exact_sum("value").alias("sum"), exact_avg("value").alias("average"), F.max("value").alias("max"), F.count("value").alias("matches_played")).withColumn("scope", F.lit(scope))

    both = totals(team_match, "team").unionByName(totals(players, "player"))
    boards = spark.createDataFrame(BOARDS, "board int, metric string, scope string, aggregation string, higher boolean")
    joined = both.join(F.broadcast(boards), ["metric", "scope"])
    value = F.when(F.col("aggregation") == "sum", F.col("sum")).when(F.col("aggregation") == "max", F.col("max")).otherwise(F.col("average"))
    rows = joined.withColumn("value", value).where("matches_played > 0")
    # per match: none for a maximum, the value itself for an average
    per = F.when(F.col("aggregation") == "average", F.col("value")).when(F.col("aggregation") == "sum", F.col("value") / F.col("matches_played"))
    return rows.withColumn("per_match", per)


_BOARD_SQL = f"""WITH {LONG}, named AS (SELECT l.*, s_name, s_nationkey, n_name FROM long l JOIN supplier ON s_suppkey = player_id JOIN nation ON n_nationkey = s_nationkey),
 teams AS (SELECT metric, match_id, s_nationkey::bigint AS entity_id, n_name AS entity_name, n_name AS team_name, sum(value::decimal(18,4))::double AS value FROM named GROUP BY ALL),
 every AS (SELECT 'team' AS scope, metric, entity_id, entity_name, team_name, value FROM teams UNION ALL SELECT 'player', metric, player_id, s_name, n_name, value FROM named),
 totals AS (SELECT scope, metric, entity_id, entity_name, team_name, sum(value::decimal(18,4))::double AS s, sum(value::decimal(18,4))::double / count(value) AS a, max(value) AS m, count(value) AS matches_played FROM every GROUP BY ALL),
 boards(board, metric, scope, aggregation, higher) AS (VALUES {_BOARD_VALUES}),
 valued AS (SELECT board, metric, scope, aggregation, higher, entity_id, entity_name, team_name, CASE aggregation WHEN 'sum' THEN s WHEN 'max' THEN m ELSE a END AS value, matches_played FROM totals JOIN boards USING (metric, scope) WHERE matches_played > 0),
 ranked AS (SELECT *, rank() OVER (PARTITION BY board ORDER BY CASE WHEN higher THEN -value ELSE value END)::bigint AS rank FROM valued)"""


@query(
    "leaderboards",
    _BOARD_SQL + f""" SELECT board::int AS board, metric, scope, aggregation, rank, entity_id, entity_name, team_name, value, matches_played,
 CASE aggregation WHEN 'average' THEN value WHEN 'sum' THEN value / matches_played END AS per_match FROM ranked WHERE scope = 'team' OR rank <= {CAP}""",
)
def leaderboards(spark: SparkSession, d: str) -> DataFrame:
    """Every board with competition ranks; player boards are capped, ties at the cap stay."""
    rows = board_rows(spark, d)
    # apart, so that the cap is a plain bound on the rank, which cuts player boards ahead of the shuffle
    players = cap_with_ties(competition_rank(rows.where("scope = 'player'"), ["board"], "value", F.col("higher")), CAP)
    teams = competition_rank(rows.where("scope = 'team'"), ["board"], "value", F.col("higher"))
    return players.unionByName(teams).select("board", "metric", "scope", "aggregation", "rank", "entity_id", "entity_name", "team_name", "value", "matches_played", "per_match")


@query(
    "leaderboard_teaser",
    _BOARD_SQL + """, shown AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY rank, entity_id) AS n FROM ranked WHERE rank <= 3)
 SELECT board::int AS board, count(*) FILTER (n <= 3) AS shown_rows, count(*) FILTER (n > 3) AS hidden_rows, CASE WHEN min(rank) FILTER (n > 3) = max(rank) FILTER (n > 3) THEN min(rank) FILTER (n > 3) END AS hidden_rank FROM shown GROUP BY 1""",
)
def teaser(spark: SparkSession, d: str) -> DataFrame:
    """Rows of rank 3 or better, three shown a board; how many are hidden, and their rank if they share one."""
    ranked = competition_rank(board_rows(spark, d), ["board"], "value", F.col("higher")).where("rank <= 3")
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("board").orderBy("rank", "entity_id")))
    hidden = F.when(F.col("n") > 3, F.col("rank"))
    return ranked.groupBy("board").agg(
        F.count_if(F.col("n") <= 3).alias("shown_rows"), F.count_if(F.col("n") > 3).alias("hidden_rows"), F.when(F.min(hidden) == F.max(hidden), F.min(hidden)).alias("hidden_rank")
    )


_FORM = "string_agg(CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for = goals_against THEN 'D' ELSE 'L' END, '' ORDER BY match_date, match_id)"


@query(
    "standings",
    f"""WITH {SIDES}, inner_ AS (SELECT s.*, a.n_regionkey AS region FROM sides s JOIN nation a ON a.n_nationkey = team JOIN nation b ON b.n_nationkey = opponent AND a.n_regionkey = b.n_regionkey),
 t AS (SELECT region, team, count(*) AS played, count(*) FILTER (goals_for > goals_against) AS won, count(*) FILTER (goals_for = goals_against) AS drawn, count(*) FILTER (goals_for < goals_against) AS lost,
 sum(goals_for)::bigint AS goals_for, sum(goals_against)::bigint AS goals_against, {_FORM} AS form FROM inner_ GROUP BY ALL)
 SELECT region, row_number() OVER (PARTITION BY region ORDER BY 3 * won + drawn DESC, goals_for - goals_against DESC, goals_for DESC, team) AS rank, count(*) OVER (PARTITION BY region, 3 * won + drawn, goals_for - goals_against, goals_for) > 1 AS tied, team, n_name AS team_name, played, won, drawn, lost, goals_for, goals_against,
 goals_for - goals_against AS goal_difference, 3 * won + drawn AS points, right(form, 5) AS form FROM t JOIN nation ON n_nationkey = team""",
)
def standings(spark: SparkSession, d: str) -> DataFrame:
    """Group tables from matches within a region: points, then difference, then goals; a full tie is marked (``total_rank`` without ``last`` fails on it)."""
    nation = table(spark, d, "nation")
    own = nation.select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("team_name"), F.col("n_regionkey").alias("region"))
    other = nation.select(F.col("n_nationkey").alias("opponent"), F.col("n_regionkey").alias("other_region"))
    rows = sides(matches(spark, d)).join(own, "team").join(other, "opponent").where("region = other_region")
    t = tally(rows, ["region", "team", "team_name"])
    ranked = total_rank(t, ["region"], [F.col("points"), F.col("goal_difference"), F.col("goals_for")], last="team")
    return ranked.select("region", "rank", "tied", "team", "team_name", "played", "won", "drawn", "lost", "goals_for", "goals_against", "goal_difference", "points", F.right("form", F.lit(5)).alias("form"))


def tally(rows: DataFrame, by: list[str]) -> DataFrame:
    """Won, drawn, lost, goals, points and the results in order of date and match."""
    result = F.when(F.col("goals_for") > F.col("goals_against"), "W").when(F.col("goals_for") == F.col("goals_against"), "D").otherwise("L")
    listed = F.sort_array(F.collect_list(F.struct("match_date", "match_id", result.alias("r"))))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("played"), F.count_if(result == "W").alias("won"), F.count_if(result == "D").alias("drawn"), F.count_if(result == "L").alias("lost"),
        F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"), F.array_join(F.transform(listed, lambda x: x["r"]), "").alias("form"),
    )
    return out.withColumn("goal_difference", F.col("goals_for") - F.col("goals_against")).withColumn("points", 3 * F.col("won") + F.col("drawn"))


@query(
    "team_records",
    f"""WITH {SIDES} SELECT team, count(*) AS played, count(*) FILTER (goals_for > goals_against) AS won, count(*) FILTER (goals_for = goals_against) AS drawn, count(*) FILTER (goals_for < goals_against) AS lost,
 sum(goals_for)::bigint AS goals_for, sum(goals_against)::bigint AS goals_against, sum(goals_for - goals_against)::bigint AS goal_difference,
 coalesce(sum(CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END) FILTER (stage = 1), 0)::bigint AS group_points, max(stage)::int AS furthest_stage FROM sides GROUP BY 1""",
)
def team_records(spark: SparkSession, d: str) -> DataFrame:
    """Whole-tournament record; points only from the group stage (stage 1), the furthest stage by ordinal."""
    rows = sides(matches(spark, d))
    points = F.when(F.col("goals_for") > F.col("goals_against"), 3).when(F.col("goals_for") == F.col("goals_against"), 1).otherwise(0)
    more = rows.groupBy("team").agg(F.coalesce(F.sum(F.when(F.col("stage") == 1, points)), F.lit(0)).alias("group_points"), F.max("stage").alias("furthest_stage"))
    return tally(rows, ["team"]).drop("form", "points").join(more, "team")


@query(
    "player_profiles",
    f"""WITH {STATS}, t AS (SELECT player_id, count(*) AS appearances, sum(quantity::decimal(18,4))::double AS quantity, sum(revenue::decimal(18,4))::double AS revenue, max(revenue) AS top_revenue, sum(lines)::bigint * 30 AS minutes,
 sum(tax::decimal(18,4))::double AS tax FROM stats GROUP BY 1), w AS (SELECT l_suppkey AS player_id, sum((l_discount::decimal(18,4) * l_extendedprice::decimal(18,4))::decimal(38,4))::double AS c, sum(l_extendedprice::decimal(18,4))::double AS a FROM lineitem GROUP BY 1)
 SELECT s_suppkey AS player_id, s_name AS name, s_nationkey AS team, coalesce(appearances, 0)::bigint AS appearances, coalesce(minutes, 0)::bigint AS minutes, coalesce(t.quantity, 0.0) AS quantity, coalesce(t.revenue, 0.0) AS revenue, coalesce(top_revenue, 0.0) AS top_revenue,
 coalesce(c / nullif(a, 0) * 100, 0.0) AS completion, CASE WHEN minutes > 0 THEN t.quantity / minutes * 90 END AS quantity_per_90, CASE WHEN minutes > 0 THEN t.tax / minutes * 90 END AS tax_per_90
 FROM supplier LEFT JOIN t ON t.player_id = s_suppkey LEFT JOIN w ON w.player_id = s_suppkey""",
)
def player_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Totals, best, weighted completion and per-90 rates from unrounded values.
    Starts from the dimension, so players without appearances have zero rows."""
    t = player_match(spark, d).groupBy("player_id").agg(
        F.count("*").alias("appearances"), exact_sum("quantity").alias("quantity"), exact_sum("revenue").alias("revenue"), F.max("revenue").alias("top_revenue"), (F.sum("lines") * 30).alias("minutes"), exact_sum("tax").alias("tax")
    )
    product = (F.col("l_discount").cast("decimal(18,4)") * F.col("l_extendedprice").cast("decimal(18,4)")).cast("decimal(38,4)")
    w = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("player_id")).agg(F.sum(product).cast("double").alias("c"), exact_sum("l_extendedprice").alias("a"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("team")).join(t, "player_id", "left").join(w, "player_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    rate = lambda c: F.when(F.col("minutes") > 0, F.col(c) / F.col("minutes") * 90).alias(f"{c}_per_90")
    return p.select(
        "player_id", "name", "team", F.coalesce("appearances", F.lit(0)).alias("appearances"), F.coalesce("minutes", F.lit(0)).alias("minutes"), zero("quantity"), zero("revenue"), zero("top_revenue"),
        F.coalesce(F.try_divide("c", F.nullif("a", F.lit(0.0))) * 100, F.lit(0.0)).alias("completion"), rate("quantity"), rate("tax"),
    )


@query(
    "weighted_and_plain_ratio",
    """SELECT l_suppkey AS player_id, sum((l_discount::decimal(18,4) * l_extendedprice::decimal(18,4))::decimal(38,4))::double / nullif(sum(l_extendedprice::decimal(18,4))::double, 0) AS weighted, sum(l_discount::decimal(18,4))::double / count(l_discount) AS plain FROM lineitem GROUP BY 1""",
)
def ratios(spark: SparkSession, d: str) -> DataFrame:
    """The weighted ratio and the unweighted mean are two metrics."""
    product = (F.col("l_discount").cast("decimal(18,4)") * F.col("l_extendedprice").cast("decimal(18,4)")).cast("decimal(38,4)")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("player_id")).agg(
        F.try_divide(F.sum(product).cast("double"), F.nullif(exact_sum("l_extendedprice"), F.lit(0.0))).alias("weighted"), exact_avg("l_discount").alias("plain")
    )


@query(
    "formation_usage",
    f"""WITH {SIDES}, u AS (SELECT team, stage::bigint AS formation, count(*) AS matches FROM sides GROUP BY ALL) SELECT team, formation, matches, matches * 100.0::double / sum(matches) OVER (PARTITION BY team) AS share,
 row_number() OVER (PARTITION BY team ORDER BY matches DESC, formation) AS position FROM u""",
)
def formation_usage(spark: SparkSession, d: str) -> DataFrame:
    """Count and share of each formation of a team; most used first, ties by formation."""
    u = sides(matches(spark, d)).groupBy("team", F.col("stage").cast("bigint").alias("formation")).agg(F.count("*").alias("matches"))
    w = Window.partitionBy("team")
    return u.withColumn("share", F.col("matches") * F.lit(100.0) / F.sum("matches").over(w)).withColumn("position", F.row_number().over(w.orderBy(F.desc("matches"), "formation")).cast("bigint"))


@query(
    "modal_attribute",
    """WITH c AS (SELECT l_suppkey AS player_id, l_linestatus || l_returnflag AS position, count(*) AS n, min(l_shipdate) AS seen FROM lineitem GROUP BY ALL)
 SELECT player_id, position, n AS matches FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, seen, position) AS k FROM c) WHERE k = 1""",
)
def modal_attribute(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent position; of equals the one seen first."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("player_id"), F.concat("l_linestatus", "l_returnflag").alias("position")).agg(F.count("*").alias("n"), F.min("l_shipdate").alias("seen"))
    return c.groupBy("player_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "seen", "position")).alias("b")).select("player_id", "b.position", (-F.col("b.k")).alias("matches"))


@query(
    "single_valued",
    """SELECT c_nationkey AS team, count(DISTINCT c_mktsegment) AS segments, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS segment, count(DISTINCT c_nationkey) = 1 AS one_team FROM customer GROUP BY 1""",
)
def single_valued(spark: SparkSession, d: str) -> DataFrame:
    """How many values an attribute has in a group, and the value where it is one."""
    n = F.count_distinct("c_mktsegment")
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("team")).agg(n.alias("segments"), F.when(n == 1, F.min("c_mktsegment")).alias("segment"), (F.count_distinct("c_nationkey") == 1).alias("one_team"))


@query(
    "leaf_means",
    f"""WITH {LONG} SELECT s_nationkey AS team, metric AS leaf, sum(value::decimal(18,4))::double / count(value) AS mean, count(value) AS matches FROM long JOIN supplier ON s_suppkey = player_id GROUP BY ALL""",
)
def leaf_means(spark: SparkSession, d: str) -> DataFrame:
    """Unweighted mean of each leaf of a team's identity, from the flattened form."""
    facts = player_match(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("team")), "player_id")
    return unpivoted(facts.select("team", *METRICS), ["team"], METRICS).groupBy("team", F.col("metric").alias("leaf")).agg(exact_avg("value").alias("mean"), F.count("value").alias("matches"))


@query(
    "story_stats",
    f"""WITH {STATS} SELECT match_id, s_nationkey AS team, max(revenue) AS top, sum(quantity::decimal(18,4))::double AS total FROM stats JOIN supplier ON s_suppkey = player_id GROUP BY ALL""",
)
def story_stats(spark: SparkSession, d: str) -> DataFrame:
    """A team's top value is the best of its players' in the match."""
    facts = player_match(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("team")), "player_id")
    return facts.groupBy("match_id", "team").agg(F.max("revenue").alias("top"), exact_sum("quantity").alias("total"))


@query(
    "knockout_scores",
    f"""WITH {GAMES}, g AS (SELECT match_id, home, away, count(*) FILTER (l_linenumber <= 3 AND l_returnflag = 'R') AS h90, count(*) FILTER (l_linenumber <= 3 AND l_returnflag = 'A') AS a90, home_goals AS h120, away_goals AS a120
 FROM games JOIN lineitem ON l_orderkey = match_id WHERE stage > 1 GROUP BY ALL)
 SELECT match_id, h90, a90, CASE WHEN h90 = a90 THEN h120 END AS h_et, CASE WHEN h90 = a90 THEN a120 END AS a_et, CASE WHEN h90 <> a90 THEN 'regular' WHEN h120 <> a120 THEN 'extra-time' ELSE 'shootout' END AS decided_by,
 CASE WHEN h90 > a90 THEN home WHEN h90 < a90 THEN away WHEN h120 > a120 THEN home WHEN h120 < a120 THEN away END AS winner FROM g""",
)
def knockout_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score at two limits, how the match was decided and who won."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id"), "l_linenumber", "l_returnflag")
    at = lambda flag: F.count_if((F.col("l_linenumber") <= 3) & (F.col("l_returnflag") == flag))
    regular = lines.groupBy("match_id").agg(at("R").alias("h90"), at("A").alias("a90"))
    g = matches(spark, d).where("stage > 1").join(regular, "match_id")
    level = F.col("h90") == F.col("a90")
    winner = F.expr("case when h90 > a90 then home when h90 < a90 then away when home_goals > away_goals then home when home_goals < away_goals then away end")
    return g.select(
        "match_id", "h90", "a90", F.when(level, F.col("home_goals")).alias("h_et"), F.when(level, F.col("away_goals")).alias("a_et"),
        F.when(~level, "regular").when(F.col("home_goals") != F.col("away_goals"), "extra-time").otherwise("shootout").alias("decided_by"), winner.alias("winner"),
    )


_RESULTS_SQL = f"""WITH {GAMES} SELECT stage, match_id, home, away, home_goals, away_goals, row_number() OVER (ORDER BY stage, match_id) AS position FROM games WHERE stage > 1"""


@query("results_by_stage", _RESULTS_SQL)
@query("whole_results_by_stage", _RESULTS_SQL)
def whole_results_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """All knockout results by stage ordinal, then match number."""
    knockouts = matches(spark, d).where("stage > 1").select("stage", "match_id", "home", "away", "home_goals", "away_goals")
    return table_positions(knockouts, {"position": F.col("key_")}, "stage", "match_id")


@query(
    "quintile_bands",
    """WITH e AS (SELECT l_suppkey % 50 AS team, l_suppkey AS src, l_partkey AS dst, sum(l_quantity)::bigint AS weight FROM lineitem GROUP BY ALL),
 t AS (SELECT team, percentile_disc(0.2) WITHIN GROUP (ORDER BY weight) AS t1, percentile_disc(0.4) WITHIN GROUP (ORDER BY weight) AS t2, percentile_disc(0.6) WITHIN GROUP (ORDER BY weight) AS t3, percentile_disc(0.8) WITHIN GROUP (ORDER BY weight) AS t4, min(weight) < max(weight) AS varied FROM e GROUP BY 1)
 SELECT team, src, dst, weight, (1 + CASE WHEN varied THEN (t1 < weight)::int + (t2 < weight)::int + (t3 < weight)::int + (t4 < weight)::int ELSE 0 END)::bigint AS band FROM e JOIN t USING (team)""",
)
def quintile_bands(spark: SparkSession, d: str) -> DataFrame:
    """Edges in five weight bands by nearest-rank thresholds of their team."""
    edges = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("team"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").cast("bigint").alias("weight"))
    return edges.join(quantile_thresholds(edges, ["team"], "weight"), "team").select("team", "src", "dst", "weight", band_of(F.col("weight"), F.col("thresholds")).alias("band"))


@query(
    "visible_edges",
    """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity)::bigint AS weight FROM lineitem GROUP BY ALL), t AS (SELECT src, percentile_disc(0.2) WITHIN GROUP (ORDER BY weight) AS t1, min(weight) < max(weight) AS varied FROM e GROUP BY 1)
 SELECT src, dst, weight FROM e JOIN t USING (src) WHERE NOT varied OR weight > t1""",
)
def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges above the lowest band; all edges where there are no thresholds."""
    edges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").cast("bigint").alias("weight"))
    t = quantile_thresholds(edges, ["src"], "weight")
    return edges.join(t, "src").where((F.size("thresholds") == 0) | (band_of(F.col("weight"), F.col("thresholds")) > 1)).select("src", "dst", "weight")


@query(
    "compare_entities",
    _BOARD_SQL + """, s AS (SELECT * FROM ranked WHERE scope = 'team' AND aggregation = 'sum') SELECT a.metric AS metric, a.value AS left_value, b.value AS right_value, CASE WHEN a.value = b.value THEN 'tie' WHEN (a.value > b.value) = a.higher THEN 'left' ELSE 'right' END AS leader
 FROM s a JOIN s b ON a.board = b.board AND a.entity_id = 1 AND b.entity_id = 2""",
)
def compare_entities(spark: SparkSession, d: str) -> DataFrame:
    """Two entities side by side on each metric, with the leader in the board's direction."""
    rows = board_rows(spark, d).where("scope = 'team' and aggregation = 'sum'").select("board", "metric", "entity_id", "value", "higher")
    a, b = rows.where("entity_id = 1").withColumnRenamed("value", "left_value"), rows.where("entity_id = 2").select("board", F.col("value").alias("right_value"))
    lead = F.when(F.col("left_value") == F.col("right_value"), "tie").when((F.col("left_value") > F.col("right_value")) == F.col("higher"), "left").otherwise("right")
    return a.join(b, "board").select("metric", "left_value", "right_value", lead.alias("leader"))


@query(
    "player_trend",
    f"""WITH {STATS}, {GAMES} SELECT player_id, match_id, match_date, row_number() OVER (PARTITION BY player_id ORDER BY match_date, match_id) AS appearance, quantity AS value FROM stats JOIN games USING (match_id)""",
)
def player_trend(spark: SparkSession, d: str) -> DataFrame:
    """A player's values in order of date, each joined to its match."""
    rows = player_match(spark, d).join(matches(spark, d).select("match_id", "match_date"), "match_id")
    return rows.select("player_id", "match_id", "match_date", F.row_number().over(Window.partitionBy("player_id").orderBy("match_date", "match_id")).cast("bigint").alias("appearance"), F.col("quantity").alias("value"))
