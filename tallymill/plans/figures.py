"""The registry of checks over reports that orders stand for, some with one figure off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import domain_checks
from tallymill.plans.registry import query
from tallymill.sources.tables import clustered, table

#: The figures of a report that holds.
GOOD = {
    "shots.markers": 12, "shots.rows": 12, "shots.linked": 12, "lineup.starters": 11, "lineup.keepers": 1, "lineup.shirts": 23, "lineup.players": 23, "formation.defence": 4, "formation.midfield": 3, "formation.attack": 3,
    "goals.own": 2, "goals.given": 1, "goals.players": 2, "score": 3, "possession.own": 51.5, "possession.other": 40.5, "possession.contest": 8, "attempts": 12, "attempts.on-target": 5, "passes": 400, "passes.completed": 340, "passes.percent": 85, "passes.rate": 85,
    "length": 40, "width": 50, "drawn.feet": 20, "drawn.hands": 6, "drawn.throw": 4, "drawn.total": 30, "printed.feet": 20, "printed.hands": 6, "printed.throw": 4, "faced.save": 3, "faced.block": 2, "faced.claim": 1, "faced.none": 4, "faced": 10, "faced.tile": 10,
    "aerial.cross": 5, "aerial.corner": 4, "aerial.free-kick": 2, "aerial.throw": 1, "aerial.long": 3, "aerial.other": 1, "aerial.total": 16, "involved.series": 60, "involved.printed": 64, "corners.left": 3, "corners.right": 4, "corners": 7, "free-kicks": 9, "throw-ins": 20, "set-plays": 36,
    "zone.1": 40000, "zone.2": 30000, "zone.3": 20000, "zone.4": 8000, "zone.5": 2000, "distance": 100000, "kilometres": 100, "moves.in": 10, "moves.out": 12, "moves.front": 14, "moves": 36, "moves.grid": 36, "moves.in.players": 10, "moves.out.players": 12, "moves.front.players": 14,
    "momentum.peak": 8, "momentum.label": 8, "crosses.markers": 9, "crosses.table": 9, "tackles.markers": 7, "tackles.table": 7, "blocks.markers": 5, "blocks.table": 5, "interceptions.markers": 6, "interceptions.table": 6,
    "offers.low": 20, "offers.mid": 30, "offers.high": 10, "offers": 60, "offers.inside": 35, "offers.outside": 25, "offers.table": 60, "offers.players": 60, "received": 25, "received.table": 25, "received.players": 25, "offers.rows": 11, "offers.rows-right": 11,
    "top.passes": 60, "network.total": 300, "top.percent": 20,
}
#: Reports of a task; each has about a hundred figures, items and stamps.
REPORTS = 25_000
#: Figure that is off in the reports whose number leaves 0 by the divisor, and the checks that this breaks.
OFF = (
    ("shots.linked", 7, ("shots-link-rate",)), ("lineup.keepers", 11, ("domain-a-goalkeeper-count",)), ("drawn.total", 13, ("goalkeeping-distribution-sum",)), ("printed.hands", 17, ("goalkeeping-distribution-printed",)),
    ("moves.out", 19, ("domain-g-internal-consistency", "receiving-movement-grid-total", "receiving-movement-domain-g")), ("top.percent", 23, ("pass-network-top5-pct",)), ("score", 29, ("domain-a-goal-reconciliation", "domain-g-goals-reconciliation")),
    ("crosses.table", 31, ("crosses-marker-count",)), ("aerial.long", 37, ("goalkeeping-aerial-sum",)), ("kilometres", 41, ("domain-g-distance-reconciliation",)), ("throw-ins", 43, ("set-plays-totals",)), ("width", 47, ("tactical-metre-bounds",)),
)
_IDS = sorted({c.id for c in domain_checks.CHECKS} | {i for i, *_ in domain_checks.LISTS} | {i for i, *_ in domain_checks.CLOCKS})
_ROWS = {i: sum(c.id == i for c in domain_checks.CHECKS) or 1 for i in _IDS}
#: Divisor of what breaks a list and a clock.
_LIST_OFF, _CLOCK_OFF = 5, 3
_FAILS = {i: " + ".join([f"(k % {p} = 0)::int" for _, p, ids in OFF if i in ids] + [f"(k % {_LIST_OFF} = 0)::int" for j, *_ in domain_checks.LISTS if i == j] + [f"(k % {_CLOCK_OFF} = 0)::int" for j, *_ in domain_checks.CLOCKS if i == j]) or "0" for i in _IDS}


@query(
    "domain_checks",
    "WITH o AS (SELECT o_orderkey AS k FROM orders) " + " UNION ALL ".join(f"SELECT '{i}' AS \"check\", (count(*) * {_ROWS[i]} - sum({_FAILS[i]}))::bigint AS passed, sum({_FAILS[i]})::bigint AS failed, CASE WHEN sum({_FAILS[i]}) > 0 THEN 'fail' ELSE 'pass' END AS result FROM o" for i in _IDS),
)
def domain_checks_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """All checks over a report for each order. Reports are dealt to tasks before they unfold
    into figures, which are met in their task."""
    k = F.col("k")
    orders = clustered(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k", REPORTS)
    off = {name: divisor for name, divisor, _ in OFF}
    value = lambda n, v: F.lit(float(v)) if n not in off else F.when(k % off[n] == 0, v + 1000.0).otherwise(float(v))
    figures = orders.select("k", F.explode(F.array(*(F.struct(F.lit(n).alias("figure"), value(n, v).alias("value")) for n, v in GOOD.items()))).alias("f")).select("k", "f.*")
    side = lambda name, items: F.transform(items, lambda x: F.struct(F.lit(name).alias("list"), x.alias("item")))
    three = F.array(k % 5, k % 7, k % 5)
    lists = orders.select("k", F.explode(F.concat(side("off", three), side("on", F.when(k % _LIST_OFF == 0, F.array(k % 5, k % 7, k % 7 + 9)).otherwise(F.reverse(three))))).alias("f")).select("k", "f.*")
    minutes = F.when(k % _CLOCK_OFF == 0, F.array(*map(F.lit, (1, 2, 2, 90)))).otherwise(F.array(*map(F.lit, (1, 2, 46, 90))))
    stamps = orders.select("k", F.explode(F.array(*(F.lit(s) for _, s in domain_checks.CLOCKS))).alias("series"), minutes.alias("m"))
    stamps = stamps.select("k", "series", F.posexplode("m").alias("slot", "minute")).withColumn("stoppage", F.lit(None).cast("int"))
    rows = domain_checks.figure_checks(figures, ["k"]).unionByName(domain_checks.list_checks(lists, ["k"])).unionByName(domain_checks.clock_checks(stamps, ["k"]))
    return domain_checks.summary(rows).select("check", "passed", "failed", "result")
