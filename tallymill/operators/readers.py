"""Readers of printed tables, maps and charts: positioned marks become typed rows.

What a reader cannot trust fails the query with a message that names the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators import gates, sequence, spatial
from tallymill.operators.matching import must

# --- tables ------------------------------------------------------------------------------


def read_table(words: DataFrame, report: str, page: str, header: tuple[str, ...], columns: tuple[str, ...], tolerance: float = 3.0, slack: float = 1.0) -> DataFrame:
    """``read_pages`` of ``words(report, page, word, x, y, text)``, a row for each word."""
    placed = words.where(F.col(report).isNotNull() & F.col(page).isNotNull() & F.col("word").isNotNull())
    # the words of one printed page
    pages = placed.groupBy(report, page).agg(F.collect_list(F.struct("y", "x", "word", "text")).alias("words"))
    return read_pages(pages, report, page, header, columns, tolerance, slack)


def read_pages(pages: DataFrame, report: str, page: str, header: tuple[str, ...], columns: tuple[str, ...], tolerance: float = 3.0, slack: float = 1.0) -> DataFrame:
    """``(report, page, row, ordinal, cells)`` of the rows below each page's header.

    ``pages(report, page, words)`` hold their words as an array of ``(y, x, word, text)``, so no word
    is shuffled or staged. Words stand on visual rows: from the top, a row opens where a word is lower
    than the first of the row before by more than the tolerance. Exactly
    one row of a page holds all ``header`` words; on it each of ``columns`` stands once,
    from left to right, and opens a column. A row counts where its leftmost word is a number.
    ``cells`` are arrays of words, one for what is left of the first of ``columns`` and one
    for each of them. ``ordinal`` counts a report's rows over its pages.
    """
    at = [report, page]
    said = lambda t: lambda w: w["text"] == t
    found = pages.select(*at, F.filter("words", lambda w: w["y"].isNotNull()).alias("words_")).where("size(words_) > 0")
    found = found.withColumn("heights_", F.array_sort(F.array_distinct(F.transform("words_", lambda w: w["y"].cast("double")))))
    opens = lambda s, y: F.coalesce(y - F.get(s, F.size(s) - 1) > tolerance, F.lit(True))
    found = found.withColumn("opens_", F.aggregate("heights_", F.array().cast("array<double>"), lambda s, y: F.when(opens(s, y), F.concat(s, F.array(y))).otherwise(s)))
    found = found.select(*at, F.transform("opens_", lambda y: F.filter("words_", lambda w: (w["y"] >= y) & (w["y"] - y <= tolerance))).alias("rows_"))

    def heads(row: Column) -> Column:
        is_head = F.lit(True)
        for t in header:
            is_head &= F.coalesce(F.exists(row, said(t)), F.lit(False))
        return is_head

    found = found.withColumn("heads_", F.transform("rows_", heads))
    head = must(F.size(F.filter("heads_", lambda h: h)) == 1, F.array_position("heads_", True), "a page of a table needs exactly one header row")
    found = found.select(*at, "rows_", head.cast("int").alias("head_"))
    named = [F.filter(F.get("rows_", F.col("head_") - 1), said(t)) for t in columns]
    found = found.withColumns({"n_": F.array(*map(F.size, named)), "x_": F.array(*(F.array_min(F.transform(w, lambda v: v["x"])) for w in named))})
    once = F.forall("n_", lambda n: n == 1) & F.coalesce(F.col("x_") == F.sort_array("x_"), F.lit(False))
    found = found.select(*at, "rows_", "head_", must(once, F.col("x_"), "the header's words do not cut the columns").alias("starts_"))
    column = lambda w: F.size(F.filter("starts_", lambda s: w["x"] >= s - slack))
    body = F.transform(F.slice("rows_", F.col("head_") + 1, F.size("rows_")), lambda row, i: F.struct((F.col("head_") + 1 + i).cast("bigint").alias("row"), F.sort_array(F.transform(row, lambda w: F.struct(column(w).alias("column"), w["x"].alias("x"), w["word"].alias("word"), w["text"].alias("text")))).alias("words")))
    leftmost = lambda row: F.array_min(F.transform(row["words"], lambda w: F.struct(w["x"].alias("x"), w["word"].alias("word"), w["text"].alias("text"))))["text"]
    rows = found.select(*at, "starts_", F.explode(body).alias("r")).where(leftmost(F.col("r")).rlike(r"\A[0-9]+\z"))
    cell = lambda k: F.transform(F.filter("r.words", lambda w: w["column"] == k), lambda w: w["text"])
    wide = rows.select(*at, F.col("r.row").alias("row"), F.array(*(cell(k) for k in range(len(columns) + 1))).alias("cells"))
    return wide.select(*at, "row", F.row_number().over(Window.partitionBy(report).orderBy(page, "row")).cast("bigint").alias("ordinal"), "cells")


def meaning(words: Column, labels: dict[str, str], what: str) -> Column:
    """The value of a printed label; one without a value fails."""
    label = F.array_join(words, " ")
    found = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[label]
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"{what} has an unknown label: "), label)))


def attempts(words: DataFrame, report: str, page: str, outcome: dict[str, str], body: dict[str, str], delivery: dict[str, str]) -> DataFrame:
    """``(report, page, ordinal, minute, shirt, player, outcome, body_part, delivery)`` of printed attempts,
    given as words, or as pages with an array of ``words``."""
    read = (read_pages if "words" in words.columns else read_table)(words, report, page, ("Time", "Player", "Outcome"), ("Player", "Outcome", "Body", "Delivery"))
    time, player = F.col("cells")[0], F.col("cells")[1]
    named = (F.size(player) >= 2) & player[0].rlike(r"\A[0-9]+\z")
    return read.select(
        report, page, "ordinal", must(F.size(time) == 1, time[0].cast("int"), "the time cell is not one minute").alias("minute"), must(named, player[0].cast("int"), "the player cell is not a number and a name").alias("shirt"),
        F.array_join(F.slice(player, 2, F.size(player)), " ").alias("player"), meaning(F.col("cells")[2], outcome, "outcome").alias("outcome"), meaning(F.col("cells")[3], body, "body part").alias("body_part"), meaning(F.col("cells")[4], delivery, "delivery").alias("delivery"),
    )


# --- maps --------------------------------------------------------------------------------


def read_map(marks: DataFrame, frames: DataFrame, by: list[str], key: DataFrame, size: tuple[float, float], area: tuple[float, float], margin: float = 1.0, collapse: tuple[str, str] | None = None) -> DataFrame:
    """``(by, mark, outcome, x, y, position)``: the markers of pitch maps, in the pitch's hundredths.

    ``marks(mark, kind, filled, x, y, w, h, colour)`` and ``frames(frame, x0, y0, x1, y1)``.
    The pitch is the largest frame whose area lies between the bounds. Candidates are filled
    curves of a marker's size in it or on its margin; a row on which three colours meet is
    the legend; a colour that ``key(colour, outcome)`` lacks fails. With ``collapse`` a weak mark
    under a strong one at the same place goes. Small overshoots of the lines are moved
    onto them, larger ones fail. ``position`` goes by the page's y, then x.
    """
    sides = ("x0", "y0", "x1", "y1")
    sized = frames.withColumn("area_", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).where((F.col("area_") > area[0]) & (F.col("area_") < area[1]))
    pitch = sized.groupBy(*by).agg(F.max(F.struct("area_", (-F.col("frame")).alias("last_"), *sides)).alias("m_")).select(*by, *(F.col(f"m_.{c}").alias(f"{c}_") for c in sides))
    fit = (F.col("kind") == "curve") & F.col("filled") & F.col("w").between(*size) & F.col("h").between(*size)
    held = F.col("x").between(F.col("x0_") - margin, F.col("x1_") + margin) & F.col("y").between(F.col("y0_") - margin, F.col("y1_") + margin)
    found = marks.where(fit).join(pitch, by).where(held).withColumn("line_", F.round("y", 1))
    # windows by map and more, which marks dealt by map meet without a shuffle
    colours = F.size(F.collect_set("colour").over(Window.partitionBy(*by, "line_")))
    found = spatial.keyed(found.withColumn("n_", colours).where("n_ < 3").drop("n_"), key, "colour", "outcome")
    if collapse:
        found = sequence.collapse_pairs(found, [*by, "x", "y"], "outcome", *collapse)
    onto = lambda c: gates.within(F.round(c, 2), 0.0, 100.0, 0.5, "a marker lies outside the pitch")
    up, across = 100 * (F.col("y1_") - F.col("y")) / (F.col("y1_") - F.col("y0_")), 100 * (F.col("x") - F.col("x0_")) / (F.col("x1_") - F.col("x0_"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("y", "x", "mark")).cast("bigint")
    return found.select(*by, "mark", "outcome", onto(up).alias("px_"), onto(across).alias("py_"), place.alias("position")).withColumnsRenamed({"px_": "x", "py_": "y"})


# --- charts ------------------------------------------------------------------------------

#: Points, slots, units and shares by which a chart may differ from its grid.
NEAR, PITCH_NEAR, SNAP, WHOLE, UNIT_NEAR, SHARE, SHARE_NEAR = 0.05, 0.05, 0.05, 0.02, 0.05, 0.70, 0.02


def nearest_step(values: Column, tolerance: float) -> Column:
    """The largest step of which all values of a sorted array are near multiples. Each value
    is reduced against the step so far by remainders to the nearest multiple; a pair of
    doubles needs less than 64 of these."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def meet(x: Column, y: Column) -> Column:
        down = lambda s, _: F.when(s["b"] > tolerance, pair(s["b"], F.abs(s["a"] - s["b"] * F.rint(s["a"] / s["b"])))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), pair(F.greatest(x, y), F.least(x, y)), down, lambda s: s["a"])

    return F.aggregate(values, F.get(values, F.lit(0)), meet)


def read_charts(bars: DataFrame, axes: DataFrame, ticks: DataFrame, by: str) -> DataFrame:
    """``(by, slot, home, away, top_label, warning)``: a row for every slot of every chart,
    zero where no bar is drawn.

    ``bars(side, x0, y0, x1, y1)``, ``axes(x0, x1, top, bottom, top_label)`` and
    ``ticks(label, x)``. Home bars grow up from the middle of the axis, away bars down.
    A slot's width follows from the ticks 15 and 45, from the plot's width and from the
    bars, and all must agree; the unit is the step that all heights share, never the
    printed label. Bars off the baseline, off a slot's centre, twice in a slot, of
    another width, or no whole number of units fail, and so does a tallest bar that
    does not fill the axis. A chart without bars is one row with a warning.
    """
    home = F.col("side") == "home"
    height = F.col("y1") - F.col("y0")
    edge = F.when(home, F.col("y1")).otherwise(F.col("y0"))
    drawn = bars.groupBy(by).agg(  # the bars of one chart
        F.min(edge).alias("e0"), F.max(edge).alias("e1"), F.min("x0").alias("l0"), F.max("x0").alias("l1"), F.max(height).alias("peak"), F.sort_array(F.collect_set(height)).alias("heights"),
        F.count_if(~F.col("side").isin("home", "away")).alias("odd"),
    )
    tick = lambda t: F.col("label") == t
    printed = ticks.groupBy(by).agg(*(f for t in ("15", "45") for f in (F.count_if(tick(t)).alias(f"n{t}"), F.min(F.when(tick(t), F.col("x"))).alias(f"t{t}"))))
    c = axes.withColumnsRenamed({"x0": "a0", "x1": "a1"}).join(drawn, by, "left").join(printed, by, "left")
    middle = (F.col("top") + F.col("bottom")) / 2
    once = (F.col("n15") == 1) & (F.col("n45") == 1) & (F.col("t45") > F.col("t15"))
    c = c.withColumn("tick_", (F.col("t45") - F.col("t15")) / 30).withColumn("slots_", F.rint((F.col("a1") - F.col("a0")) / F.col("tick_"))).withColumn("pitch_", (F.col("a1") - F.col("a0")) / F.col("slots_"))
    span = F.col("l1") - F.col("l0")
    by_bars = F.when(span > 0, F.abs(span / F.rint(span / F.col("tick_")) - F.col("pitch_")) <= PITCH_NEAR).otherwise(True)
    c = c.withColumn("unit_", nearest_step(F.col("heights"), UNIT_NEAR))
    rules = (
        (once, "the ticks 15 and 45 are not printed once each"), (F.col("slots_") >= 1, "the plot holds no slot"), (F.abs(F.col("pitch_") - F.col("tick_")) <= PITCH_NEAR, "the ticks and the plot's width disagree"),
        (F.col("odd") == 0, "a bar is of neither side"), (F.col("e1") - F.col("e0") <= NEAR, "bars do not share one baseline"), (F.abs(F.col("e0") - middle) <= NEAR, "the baseline is not the middle of the axis"),
        (by_bars, "the bars' spacing and the ticks disagree"), (F.abs(F.col("peak") - (middle - F.col("top"))) <= NEAR, "the tallest bar does not fill the axis"), (F.col("unit_") > 0, "heights share no unit"),
    )
    slots = F.col("slots_").cast("int")
    for rule, message in reversed(rules):
        slots = must(rule, slots, message)
    c = c.withColumn("count_", F.when(F.col("heights").isNotNull(), slots))
    at = bars.join(c.where("count_ is not null").select(by, "a0", "pitch_", "unit_", "count_"), by)
    place, units = ((F.col("x0") + F.col("x1")) / 2 - F.col("a0")) / F.col("pitch_") - 0.5, height / F.col("unit_")
    ok = F.abs((F.col("x1") - F.col("x0")) / F.col("pitch_") - SHARE) <= SHARE_NEAR
    slot = must(ok, must((F.abs(place - F.rint(place)) <= SNAP) & F.rint(place).between(0, F.col("count_") - 1), F.rint(place).cast("int"), "a bar is not on a slot's centre"), "a bar is not of a bar's width")
    value = must(F.abs(units - F.rint(units)) <= WHOLE, F.rint(units).cast("bigint"), "a bar is no whole number of units")
    sided = at.select(by, slot.alias("slot"), home.alias("home_"), value.alias("v"))
    one = lambda cond: must(F.count_if(cond) <= 1, F.coalesce(F.sum(F.when(cond, F.col("v"))), F.lit(0)), "a slot carries two bars of one side")
    seen = sided.groupBy(by, "slot").agg(one(F.col("home_")).alias("home"), one(~F.col("home_")).alias("away"))
    dense = c.select(by, "top_label", F.explode_outer(F.when(F.col("count_").isNotNull(), F.sequence(F.lit(0), F.col("count_") - 1))).alias("slot"))
    zero = lambda k: F.when(F.col("slot").isNotNull(), F.coalesce(k, F.lit(0))).alias(k)
    return dense.join(seen, [by, "slot"], "left").select(by, "slot", zero("home"), zero("away"), "top_label", F.when(F.col("slot").isNull(), "the chart draws no bars").alias("warning"))
