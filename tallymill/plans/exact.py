"""Joins that must come out exactly, and axes of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import numbers
from tallymill.operators import exact
from tallymill.plans.registry import query
from tallymill.sources.tables import table


@query("document_of_label_or_fail", "SELECT doc_id, quality, lang, n_chars FROM labels JOIN documents USING (doc_id)")
def document_of_label_or_fail(spark: SparkSession, d: str) -> DataFrame:
    """Each row of labels has a document of its own."""
    documents = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return exact.one_to_one(table(spark, d, "labels").select("doc_id", "quality"), documents, ["doc_id"], ["lang", "n_chars"])


@query("nation_by_key_or_name", "SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def nation_by_key_or_name(spark: SparkSession, d: str) -> DataFrame:
    """Every third supplier has lost its nation's key and goes by the name alone."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    rows = table(spark, d, "supplier").join(nation.drop("n_regionkey"), F.col("s_nationkey") == F.col("key"))
    rows = rows.select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("key")).alias("key"), "name")
    return exact.by_key_else_name(rows, nation, "key", "name", "n_regionkey").select("s_suppkey", "n_regionkey")


@query("penalty_goals", "SELECT l_orderkey AS player_id, l_linenumber * 13 AS elapsed, min(l_partkey) % 5 = 0 AS penalty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def penalty_goals(spark: SparkSession, d: str) -> DataFrame:
    """Goals with the flag of the penalties that the shots tell of. A goal's elapsed minute is
    that of its stamp, a shot's is printed one lower."""
    of = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    player, elapsed = F.col("l_orderkey").alias("player_id"), F.col("l_linenumber") * 13
    shots = of.where("part % 5 = 0").select(player, (elapsed - 1).alias("raw")).select("player_id", (F.col("raw") + 1).alias("elapsed"))
    return exact.flagged_by_stamp(of.select(player, elapsed.alias("elapsed")), shots, "player_id", "elapsed", "penalty")


@query(
    "count_axes",
    """WITH t AS (SELECT p_partkey AS id, p_size AS top FROM part), u AS (SELECT *, pow(10, floor(log10(greatest(top, 1) / 4))) AS b4, pow(10, floor(log10(greatest(top, 1) / 2))) AS b2 FROM t),
 s AS (SELECT id, top, greatest(1, round(b4 * CASE WHEN b4 >= top / 4 THEN 1 WHEN b4 * 2 >= top / 4 THEN 2 WHEN b4 * 5 >= top / 4 THEN 5 ELSE 10 END))::bigint AS step,
  greatest(1, round(b2 * CASE WHEN b2 >= top / 2 THEN 1 WHEN b2 * 2 >= top / 2 THEN 2 WHEN b2 * 5 >= top / 2 THEN 5 ELSE 10 END))::bigint AS half FROM u),
 k AS (SELECT *, (top // half) * half AS outer_ FROM s),
 p AS (SELECT *, CASE WHEN top = outer_ THEN range(half, outer_ + 1, half) WHEN top - outer_ >= half / 2 THEN list_append(range(half, outer_ + 1, half), top) ELSE list_append(range(half, outer_, half), top) END AS up FROM k)
 SELECT id, step, greatest(step, ceil(top / step) * step)::bigint AS axis_top, array_to_string(list_concat(list_reverse(list_transform(up, lambda x: -x)), [0], up), ' ') AS ticks FROM p""",
)
def count_axes(spark: SparkSession, d: str) -> DataFrame:
    """Steps and ends of axes of counts; ticks to both sides with the peak among them."""
    top = F.col("p_size").cast("bigint")
    ticks = F.array_join(F.transform(numbers.peak_ticks(top), lambda t: t.cast("string")), " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numbers.count_step(top, 4).alias("step"), numbers.count_axis_top(top, 4).alias("axis_top"), ticks.alias("ticks"))
