"""Named queries with, where SQL can say it, their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: The facts of ``plans.facts`` in SQL.
STATS = """stats AS (SELECT l_orderkey AS match_id, l_suppkey AS player_id, sum(l_quantity::decimal(18,4))::double AS quantity,
 sum(l_extendedprice::decimal(18,4))::double AS revenue, sum(nullif(l_discount, 0)::decimal(18,4))::double AS discount, sum(l_tax::decimal(18,4))::double AS tax, count(*) AS lines
 FROM lineitem GROUP BY ALL)"""
GAMES = """games AS (SELECT o_orderkey AS match_id, o_orderdate::date AS match_date, substr(o_orderpriority, 1, 1)::int AS stage, c_nationkey AS home, s_nationkey AS away, home_goals, away_goals
 FROM (SELECT l_orderkey, min(l_suppkey) AS supp, count(*) FILTER (l_returnflag = 'R') AS home_goals, count(*) FILTER (l_returnflag = 'A') AS away_goals FROM lineitem GROUP BY 1) l
 JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = supp WHERE c_nationkey <> s_nationkey)"""
SIDES = GAMES + """, sides AS (SELECT match_id, match_date, stage, home AS team, away AS opponent, home_goals AS goals_for, away_goals AS goals_against, true AS is_home FROM games
 UNION ALL SELECT match_id, match_date, stage, away, home, away_goals, home_goals, false FROM games)"""
LONG = STATS + """, long AS (SELECT match_id, player_id, 'quantity' AS metric, quantity AS value FROM stats UNION ALL SELECT match_id, player_id, 'revenue', revenue FROM stats
 UNION ALL SELECT match_id, player_id, 'discount', discount FROM stats UNION ALL SELECT match_id, player_id, 'tax', tax FROM stats)"""
