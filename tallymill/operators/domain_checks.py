"""A registry of reconciliation checks over the figures of a report.

Each check compares two figures that a report states independently of each other: what a
panel prints and what a table adds up to, what is drawn and what is written. All are
evaluated from one aggregation that lays the figures of a match's side in a row; lists
and clocks have an aggregation each. A check applies where all its figures are there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Figure = Callable[[str], Column]


@dataclass(frozen=True)
class Check:
    """Passes where ``low <= page - counterpart <= high``."""

    id: str
    what: str
    needs: tuple[str, ...]
    page: Callable[[Figure], Column]
    counterpart: Callable[[Figure], Column]
    low: float = 0.0
    high: float = 0.0


def total(id_: str, parts: tuple[str, ...], whole: str | float, tolerance: float = 0.0) -> Check:
    """The parts add up to the whole."""
    fixed = isinstance(whole, (int, float))
    return Check(id_, f"{' + '.join(parts)} = {whole}", parts if fixed else (*parts, whole), lambda f: reduce(add, map(f, parts)), lambda f: F.lit(float(whole)) if fixed else f(whole), -tolerance, tolerance)


def equal(id_: str, page: str, counterpart: str | float, tolerance: float = 0.0) -> Check:
    return total(id_, (page,), counterpart, tolerance)


def covers(id_: str, drawn: str, printed: str, most: float = float("inf")) -> Check:
    """What is drawn is at least what is printed, and at most so many more."""
    return Check(id_, f"0 <= {drawn} - {printed} <= {most:g}", (drawn, printed), lambda f: f(drawn), lambda f: f(printed), 0.0, most)


def at_most(id_: str, less: str, more: str) -> Check:
    return Check(id_, f"{less} <= {more}", (less, more), lambda f: f(less), lambda f: f(more), float("-inf"), 0.0)


def between(id_: str, figure: str, most: float) -> Check:
    """Above zero and at most ``most``; the figure is held against what it may be."""
    return Check(id_, f"0 < {figure} <= {most:g}", (figure,), lambda f: f(figure), lambda f: F.when(f(figure) > 0, F.least(f(figure), F.lit(most))).otherwise(F.lit(most)))


def share(id_: str, part: str, whole: str, printed: str, tolerance: float) -> Check:
    """A printed percentage is that of its parts; nothing to divide by does not apply."""
    return Check(id_, f"{printed} = 100 * {part} / {whole}", (part, whole, printed), lambda f: f(printed), lambda f: F.try_divide(100 * f(part), f(whole)), -tolerance, tolerance)


#: Ids, operands and tolerances are fixed values.
CHECKS: tuple[Check, ...] = (
    equal("shots-marker-count", "shots.markers", "shots.rows"), equal("shots-link-rate", "shots.linked", "shots.markers"),
    equal("domain-a-starters-count", "lineup.starters", 11), equal("domain-a-goalkeeper-count", "lineup.keepers", 1), equal("domain-a-shirt-numbers-unique", "lineup.shirts", "lineup.players"), total("domain-a-formation-sum", ("formation.defence", "formation.midfield", "formation.attack"), 10),
    total("domain-a-goal-reconciliation", ("goals.own", "goals.given"), "score"),
    total("key-statistics-possession-sum", ("possession.own", "possession.other", "possession.contest"), 100, 0.2), at_most("key-statistics-internal-consistency", "attempts.on-target", "attempts"), at_most("key-statistics-internal-consistency", "passes.completed", "passes"),
    share("key-statistics-internal-consistency", "passes.completed", "passes", "passes.percent", 1.0), equal("key-statistics-shots-reconciliation", "attempts", "shots.rows"),
    between("tactical-metre-bounds", "length", 105), between("tactical-metre-bounds", "width", 68),
    total("goalkeeping-distribution-sum", ("drawn.feet", "drawn.hands", "drawn.throw"), "drawn.total"), covers("goalkeeping-distribution-printed", "drawn.feet", "printed.feet", 2), covers("goalkeeping-distribution-printed", "drawn.hands", "printed.hands", 2), covers("goalkeeping-distribution-printed", "drawn.throw", "printed.throw", 2),
    total("goalkeeping-goal-prevention-sum", ("faced.save", "faced.block", "faced.claim", "faced.none"), "faced"), equal("goalkeeping-goal-prevention-sum", "faced.tile", "faced"),
    total("goalkeeping-aerial-sum", ("aerial.cross", "aerial.corner", "aerial.free-kick", "aerial.throw", "aerial.long", "aerial.other"), "aerial.total"), at_most("goalkeeping-involvement-bound", "involved.series", "involved.printed"),
    total("set-plays-corner-sides", ("corners.left", "corners.right"), "corners"), total("set-plays-totals", ("corners", "free-kicks", "throw-ins"), "set-plays"),
    total("domain-g-zone-sum", tuple(f"zone.{k}" for k in range(1, 6)), "distance", 0.35), at_most("domain-g-internal-consistency", "passes.completed", "passes"), total("domain-g-internal-consistency", ("moves.in", "moves.out", "moves.front"), "moves"), share("domain-g-internal-consistency", "passes.completed", "passes", "passes.rate", 0.55),
    Check("domain-g-distance-reconciliation", "distance / 1000 = kilometres", ("distance", "kilometres"), lambda f: f("distance") / 1000, lambda f: f("kilometres"), -0.1, 0.1), total("domain-g-goals-reconciliation", ("goals.players", "goals.given"), "score"),
    equal("momentum-axis-scale", "momentum.peak", "momentum.label"), equal("crosses-marker-count", "crosses.markers", "crosses.table"),
    *(equal("defensive-actions-marker-count", f"{family}.markers", f"{family}.table") for family in ("tackles", "blocks", "interceptions")),
    total("receiving-offers-thirds-sum", ("offers.low", "offers.mid", "offers.high"), "offers"), total("receiving-offers-shape-sum", ("offers.inside", "offers.outside"), "offers"), equal("receiving-offers-table-sum", "offers.table", "offers"), equal("receiving-offers-table-sum", "received.table", "received"),
    equal("receiving-offers-table-pct", "offers.rows-right", "offers.rows"), total("receiving-movement-grid-total", ("moves.in", "moves.out", "moves.front"), "moves.grid"), equal("receiving-offers-domain-g", "offers", "offers.players"), equal("receiving-offers-domain-g", "received", "received.players"),
    *(equal("receiving-movement-domain-g", f"moves.{kind}", f"moves.{kind}.players") for kind in ("in", "out", "front")),
    share("pass-network-top5-pct", "top.passes", "network.total", "top.percent", 0.05 + 1e-9), at_most("pass-network-row-bound", "top.passes", "passes.completed"), at_most("pass-network-total-bound", "network.total", "passes.completed"),
)
#: Check id and the two lists whose items must be the same, with their repetitions.
LISTS = (("domain-a-substitution-pairing", "off", "on"),)
#: Check id and the series whose clock must run.
CLOCKS = (("goalkeeping-involvement-clock", "involvement"), ("momentum-coverage", "momentum"))
#: Minutes within which a series may end, without and with extra time.
ENDS = ((46, 90), (106, 120))


def _rows(df: DataFrame, by: list[str]) -> DataFrame:
    gap = F.col("page_value") - F.col("counterpart")
    # what rounding leaves of a sum of printed decimals is no difference
    ok = (gap >= F.col("low_") - 1e-9) & (gap <= F.col("high_") + 1e-9)
    result = F.when(gap.isNull(), "not-applicable").when(ok, "pass").otherwise("fail")
    return df.select(*by, "check", "what", "page_value", "counterpart", F.abs(gap).alias("delta"), result.alias("result"))


def figure_checks(figures: DataFrame, by: list[str], checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """``(by, check, what, page_value, counterpart, delta, result)`` from ``figures(by, figure,
    value)``; a figure that is stated twice with two values fails all that need it."""
    names = sorted({n for c in checks for n in c.needs})
    at = {n: k for k, n in enumerate(names)}
    # a row for each figure first, then each figure to its place: the work does not grow with their number
    value = F.col("value").cast("double")
    wide = figures.groupBy(*by).pivot("figure", names).agg(F.min(value).alias("f"), F.max(value).alias("g")).toDF(*by, *(f"{p}{k}" for k in at.values() for p in "fg"))
    # a figure of two values is as far off as can be
    wide = wide.select(*by, *(F.when(F.col(f"f{k}") == F.col(f"g{k}"), F.col(f"f{k}")).when(F.col(f"f{k}").isNotNull(), F.lit(float("nan"))).alias(f"f{k}") for k in at.values()))
    f = lambda n: F.col(f"f{at[n]}")
    row = lambda c: F.struct(F.lit(c.id).alias("check"), F.lit(c.what).alias("what"), c.page(f).alias("page_value"), c.counterpart(f).alias("counterpart"), F.lit(c.low).alias("low_"), F.lit(c.high).alias("high_"))
    return _rows(wide.select(*by, F.explode(F.array(*map(row, checks))).alias("c")).select(*by, "c.*"), by)


def list_checks(items: DataFrame, by: list[str], lists: tuple[tuple[str, str, str], ...] = LISTS) -> DataFrame:
    """Lists ``items(by, list, item)`` as multisets: ``page_value`` counts what one of the two has beyond the other."""
    out = []
    for id_, a, b in lists:
        sign = F.when(F.col("list") == a, 1).otherwise(-1)
        each = items.where(F.col("list").isin(a, b)).groupBy(*by, "item").agg(F.sum(sign).alias("n_"))
        out.append(each.groupBy(*by).agg(F.sum(F.abs("n_")).cast("double").alias("page_value")).select(*by, F.lit(id_).alias("check"), F.lit(f"{a} and {b} hold the same").alias("what"), "page_value", F.lit(0.0).alias("counterpart"), F.lit(0.0).alias("low_"), F.lit(0.0).alias("high_")))
    return _rows(reduce(DataFrame.unionByName, out), by)


def clock_checks(stamps: DataFrame, by: list[str], clocks: tuple[tuple[str, str], ...] = CLOCKS) -> DataFrame:
    """Clocks of ``stamps(by, series, slot, minute, stoppage)``: slots are dense from 0, the first is
    minute 1, each is later than the one before, a half opens without stoppage, and the last
    lies in a closing period. ``page_value`` counts what breaks these."""
    w = Window.partitionBy(*by, "series").orderBy("slot")
    clock = F.col("minute") * 1000 + F.coalesce("stoppage", F.lit(0))
    said = stamps.withColumn("dense_", F.row_number().over(w) - 1 == F.col("slot")).withColumn("up_", F.coalesce(clock > F.lag(clock).over(w), F.lit(True)))
    opens = (F.col("slot") == 0) & ((F.col("minute") != 1) | F.col("stoppage").isNotNull())
    bad = (~F.col("dense_") | ~F.col("up_") | opens).cast("int")
    last = F.max(F.struct("slot", "minute")).alias("last_")
    sums = said.groupBy(*by, "series").agg(F.sum(bad).alias("bad_"), last)
    ended = reduce(lambda x, y: x | y, (F.col("last_.minute").between(*e) for e in ENDS))
    known = reduce(lambda x, c: x.when(F.col("series") == c[1], c[0]), clocks, F.when(F.lit(False), ""))
    out = sums.select(*by, known.alias("check"), F.lit("the clock runs").alias("what"), (F.col("bad_") + (~ended).cast("int")).cast("double").alias("page_value"), F.lit(0.0).alias("counterpart"), F.lit(0.0).alias("low_"), F.lit(0.0).alias("high_"))
    return _rows(out.where("check is not null"), by)


def summary(rows: DataFrame) -> DataFrame:
    """``(check, passed, failed, not_applicable, max_delta, result)``."""
    n = lambda r: F.count_if(F.col("result") == r)
    verdict = F.when(n("fail") > 0, "fail").when(n("pass") > 0, "pass").otherwise("not-applicable")
    return rows.groupBy("check").agg(n("pass").alias("passed"), n("fail").alias("failed"), n("not-applicable").alias("not_applicable"), F.max("delta").alias("max_delta"), verdict.alias("result"))
