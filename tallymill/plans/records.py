"""Nested records with ids, sets published together, ids that stay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import text
from tallymill.operators import commit, enrich, pins
from tallymill.plans.registry import query
from tallymill.plans.reports import _LINES, _lines
from tallymill.sources import lookup
from tallymill.sources.staging import shared_folder
from tallymill.sources.tables import table

NAMES = {"name": ("player_id", "shirt_number"), "player_name": ("player_id", "shirt_number")}


def nested_matches(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each order as a record of three levels, its lineups, and its two teams."""
    side = F.when(F.col("n") % 2 == 1, "home").otherwise("away")
    l = lines.select("k", "n", side.alias("side"), F.concat(F.lit("P"), F.col("supp"), F.lit(" "), F.col("n")).alias("name"), F.concat(F.lit("p-"), F.col("supp"), F.lit("-"), F.col("n")).alias("id"))  # noqa: E741
    event = F.struct((F.col("n") * 7).alias("minute"), F.struct(F.col("name").alias("player_name"), F.col("n").alias("shirt_number")).alias("by"))
    team = lambda s: F.concat(F.lit("t-"), F.col("k"), F.lit("-"), s)
    shot = F.struct(F.col("n").alias("at"), team(F.col("side")).alias("team_id"), "name", F.col("n").alias("shirt_number"))
    of = lambda s, e: F.sort_array(F.collect_list(F.when(F.col("side") == s, e)))
    records = l.groupBy("k").agg(*(of(s, event).alias(s) for s in enrich.SIDES), F.sort_array(F.collect_list(shot)).alias("shots"), F.min("n").alias("low"))
    half = lambda s: F.struct(F.col(s).alias("events"), F.when(F.size(s) > 0, F.struct(F.get(s, F.lit(0))["by"]["player_name"].alias("name"))).alias("most"))
    winner = F.struct(F.when(F.col("low") == 1, F.concat(F.lit("Team "), F.col("k"), F.lit(" home"))).alias("winner"))
    records = records.select("k", F.struct(half("home").alias("home"), half("away").alias("away"), "shots", winner.alias("result")).alias("doc"))
    two = lines.select("k").distinct().select("k", F.explode(F.array(*map(F.lit, enrich.SIDES))).alias("side"))
    teams = two.select("k", "side", team(F.col("side")).alias("team_id"), F.concat(F.lit("Team "), F.col("k"), F.lit(" "), F.col("side")).alias("team_name"))
    return records, l.select("k", "side", F.col("n").alias("shirt"), "name", "id"), teams


@query(
    "enriched_records",
    f"""WITH {_LINES}, l AS (SELECT k, n, CASE n % 2 WHEN 1 THEN 'home' ELSE 'away' END AS side, 'P' || supp || ' ' || n AS name, 'p-' || supp || '-' || n AS id FROM lines)
 SELECT k, side AS part, n * 7 AS at, name, id FROM l UNION ALL SELECT k, 'shot', n, name, id FROM l UNION ALL SELECT k, 'most-' || side, NULL, arg_min(name, n), arg_min(id, n) FROM l GROUP BY k, side
 UNION ALL SELECT k, 'winner', NULL, 'Team ' || k || ' home', 't-' || k || '-home' FROM l GROUP BY k HAVING min(n) = 1""",
)
def enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """Ids beside every name of a record, laid out flat again: events of a side, shots without one, names without a shirt, teams."""
    records, lineups, teams = nested_matches(_lines(spark, d))
    out = enrich.add_ids(records, "k", lineups, NAMES, teams, {"winner": "winner_team_id"})
    row = lambda part, at, name, id_: F.struct(F.lit(part).alias("part"), at.cast("bigint").alias("at"), name.alias("name"), id_.alias("id"))
    none = F.lit(None)
    event = lambda s: F.transform(f"doc.{s}.events", lambda e: row(s, e["minute"], e["by"]["player_name"], e["by"]["player_id"]))
    flat = [x for s in enrich.SIDES for x in (event(s), F.array(row(f"most-{s}", none, F.col(f"doc.{s}.most.name"), F.col(f"doc.{s}.most.player_id"))))]
    flat.append(F.transform("doc.shots", lambda e: row("shot", e["at"], e["name"], e["player_id"])))
    flat.append(F.array(row("winner", none, F.col("doc.result.winner"), F.col("doc.result.winner_team_id"))))
    return out.select("k", F.explode(F.concat(*flat)).alias("r")).select("k", "r.*").where("name is not null")


@query("published_sets", "SELECT 'team' AS kind, n_nationkey::bigint AS id, n_name AS name FROM nation UNION ALL SELECT 'player', s_suppkey, s_name FROM supplier")
def published_sets(spark: SparkSession, d: str) -> DataFrame:
    """Teams and players published as one and read back."""
    folder = f"{shared_folder(spark)}/published/{uuid.uuid4().hex}"
    teams = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    players = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"))
    commit.publish(spark, {f"{folder}/teams": teams, f"{folder}/players": players}, f"{folder}/journal", expect={f"{folder}/teams": teams.count()})
    read = lambda kind: spark.read.parquet(f"{folder}/{kind}s").select(F.lit(kind).alias("kind"), "id", "name")
    return read("team").unionByName(read("player"))


@query(
    "pinned_slugs",
    """WITH p AS (SELECT p_partkey AS key, trim(regexp_replace(lower(p_brand || ' ' || p_size), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY key % 3 <> 0, key) AS k FROM p)
 SELECT 'part' AS kind, key, slug, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS id FROM k""",
)
def pinned_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Ids of parts after two runs: every third part came first and keeps its id."""
    slug = text.slug(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")))
    parts = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), slug.alias("slug"), F.col("p_partkey").alias("nr"))
    empty = parts.select("kind", "key", "slug", F.col("slug").alias("id")).where("false")
    return pins.merge_pins(pins.merge_pins(empty, parts.where("key % 3 = 0"), "nr"), parts, "nr")


@query("artifact_by_id", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def artifact_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Customers laid out by id, and the last one read back from its bucket alone."""
    folder, buckets = f"{shared_folder(spark)}/laid-out/{uuid.uuid4().hex}", 16
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    lookup.lay_out(customers, folder, "id", "v1", buckets)
    return lookup.read_one(spark, folder, "id", customers.agg(F.max("id")).first()[0], "v1", buckets)
