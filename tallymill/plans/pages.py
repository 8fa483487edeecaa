"""Marks and matrices over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import clusters, spatial
from tallymill.operators.ranking import quantile_thresholds
from tallymill.plans.facts import matches
from tallymill.plans.packs import _POINTS, _points
from tallymill.plans.registry import GAMES, query
from tallymill.sources.tables import table


@query("pitch_frames", "WITH r AS (SELECT p_brand AS page, p_partkey AS frame, p_size * p_retailprice AS area FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, frame) AS k FROM r WHERE area > 1000 AND area < 40000) SELECT page, frame, area FROM f WHERE k = 1")
def pitch_frames(spark: SparkSession, d: str) -> DataFrame:
    rects = table(spark, d, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("frame"), "p_size", "p_retailprice")
    return spatial.largest(rects, ["page"], F.col("p_size") * F.col("p_retailprice"), "frame", 1000.0, 40000.0)


@query("marker_candidates", f"WITH {_POINTS} SELECT id, page FROM pts WHERE x BETWEEN -12.0 AND 12.0 AND y BETWEEN -12.0 AND 12.0")
def marker_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inside(_points(spark, d), "x", "y", (-10.0, -10.0, 10.0, 10.0), 2.0).select("id", "page")


@query("keyed_markers", "SELECT l_suppkey AS page, CASE l_returnflag WHEN 'R' THEN 'goal' WHEN 'A' THEN 'saved' ELSE 'off' END AS outcome, count(*) AS markers FROM lineitem GROUP BY ALL")
def keyed_markers(spark: SparkSession, d: str) -> DataFrame:
    """Colours to outcomes; an unknown colour fails."""
    key = spark.createDataFrame([("R", "goal"), ("A", "saved"), ("N", "off")], "l_returnflag string, outcome string")
    return spatial.keyed(table(spark, d, "lineitem"), key, "l_returnflag", "outcome").groupBy(F.col("l_suppkey").alias("page"), "outcome").agg(F.count("*").alias("markers"))


@query("values_above_labels", f"""WITH {_POINTS.replace("vec_id % 8", "(vec_id // 2) % 8")}, c AS (SELECT a.page, a.id AS label, b.id AS value, row_number() OVER (PARTITION BY a.page, a.id ORDER BY b.y - a.y, b.id) AS k FROM pts a JOIN pts b ON a.page = b.page AND a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.x - b.x) <= 3.0 AND b.y > a.y AND b.y - a.y <= 80.0)
 SELECT page, label, value FROM c WHERE k = 1""")
def values_above_labels(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).withColumn("page", F.floor(F.col("id") / 2) % 8)
    return spatial.value_above(p.where("id % 2 = 0").withColumnRenamed("id", "label"), p.where("id % 2 = 1").withColumnRenamed("id", "value"), ["page"], 3.0, 80.0)


@query(
    "marker_clusters",
    f"""WITH RECURSIVE {_POINTS}, s AS (SELECT 0 AS it, page, id, round(x * 1000)::bigint AS x, round(y * 1000)::bigint AS y, id AS cluster, id AS label FROM pts
 UNION ALL (WITH c AS (SELECT page, cluster, any_value(label) AS label, sum(x)::double / count(*) AS x, sum(y)::double / count(*) AS y FROM s GROUP BY ALL),
  m AS (SELECT a.page, a.cluster, a.label, min(b.label) AS least FROM c a JOIN c b ON a.page = b.page AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 2000.0 * 2000.0 GROUP BY ALL),
  g AS (SELECT page, bool_and(label = least) AS settled, bool_and(cluster = label) AS apart FROM m GROUP BY page)
  SELECT it + 1, s.page, s.id, s.x, s.y, CASE WHEN settled THEN m.label ELSE s.cluster END, CASE WHEN settled THEN m.label ELSE least END FROM s JOIN m ON m.page = s.page AND m.cluster = s.cluster JOIN g ON g.page = s.page WHERE NOT (settled AND apart)))
 SELECT page, id, cluster FROM s QUALIFY it = max(it) OVER (PARTITION BY page)""",
)
def marker_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Marks of a page that lie together, merged until their centres are apart."""
    return clusters.merge_until_apart(_points(spark, d), "page", 2.0)


@query("band_labels", """WITH e AS (SELECT l_suppkey % 50 AS team, sum(l_quantity)::bigint AS weight FROM lineitem GROUP BY l_suppkey % 50, l_suppkey, l_partkey),
 t AS (SELECT team, [percentile_disc(0.2) WITHIN GROUP (ORDER BY weight), percentile_disc(0.4) WITHIN GROUP (ORDER BY weight), percentile_disc(0.6) WITHIN GROUP (ORDER BY weight), percentile_disc(0.8) WITHIN GROUP (ORDER BY weight)] AS c FROM e GROUP BY 1 HAVING min(weight) < max(weight))
 SELECT team, k::bigint AS band, c[k] AS upto FROM t, unnest([1, 2, 3, 4]) u(k)""")
def band_labels(spark: SparkSession, d: str) -> DataFrame:
    """The upper bound of each band but the last."""
    e = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("team"), "l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("weight"))
    return quantile_thresholds(e, ["team"], "weight").select("team", F.posexplode("thresholds").alias("k", "upto")).select("team", (F.col("k") + 1).cast("bigint").alias("band"), "upto")


@query("matrix_edges", "SELECT s_nationkey AS src, s_suppkey % 4 AS dst, count(*) AS volume FROM supplier GROUP BY ALL")
def matrix_edges(spark: SparkSession, d: str) -> DataFrame:
    """A pivoted matrix back to its edges of positive volume."""
    columns = [0, 1, 2, 3]
    grid = table(spark, d, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 4).alias("dst")).groupBy("src").pivot("dst", columns).count()
    long = grid.unpivot(["src"], [F.col(f"`{c}`") for c in columns], "dst", "volume")
    return long.where("volume > 0").select("src", F.col("dst").cast("bigint").alias("dst"), "volume")


@query("all_results", f"WITH {GAMES} SELECT match_id, 'group' AS part, home_goals, away_goals FROM games WHERE stage = 1 UNION ALL SELECT match_id, 'knockout', home_goals, away_goals FROM games WHERE stage > 1")
def all_results(spark: SparkSession, d: str) -> DataFrame:
    """Group and knockout results one after the other."""
    g = matches(spark, d)
    part = lambda cond, name: g.where(cond).select("match_id", F.lit(name).alias("part"), "home_goals", "away_goals")
    return part("stage = 1", "group").unionByName(part("stage > 1", "knockout"))
