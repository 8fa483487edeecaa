"""Joins with a rule: gated lookups, nearest, ranges, greedy assignment, graph neighbourhoods."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallymill.operators import linking


def must(condition: Column, value: Column, message: str) -> Column:
    """``value``, failing the query on rows where the condition is not true."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def total_lookup(facts: DataFrame, dim: DataFrame, on: list[str], take: str, message: str) -> DataFrame:
    """Left join in which every fact must find its row."""
    found = facts.join(dim.withColumn("hit_", F.lit(True)), on, "left")
    return found.withColumn(take, must(F.col("hit_"), F.col(take), message)).drop("hit_")


def corroborated(facts: DataFrame, dim: DataFrame, key: list[str], name: str, other: str) -> DataFrame:
    """Lookup by ``key``; ``name`` must agree with the dimension's ``other``. Adds
    ``by_key`` and ``agrees`` instead of failing, for reports."""
    found = facts.join(dim, key, "left")
    return found.withColumn("by_key", F.col(other).isNotNull()).withColumn("agrees", F.col(name).eqNullSafe(F.col(other)))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that has them."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    both = x.join(y, key, "full_outer").where("in_a is null or in_b is null")
    return both.select(key, F.when(F.col("in_a"), F.lit("a")).otherwise(F.lit("b")).alias("side"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row of the same ``by`` with the least distance,
    ties to the lower right id; an exact hit has distance zero and so wins.

    No join of all pairs: both tables are laid in one sequence, and the neighbour
    before is carried along it forwards, the one after backwards. Both windows run
    from the start of a group to the current row, so each is one pass.
    """
    l = left.select(*by, F.col(left_at).alias("at_"), F.col(left_id).alias(left_id), F.lit(None).cast(right.schema[right_id].dataType).alias("rid_"), F.lit(1).alias("is_left_"))  # noqa: E741
    r = right.groupBy(*by, F.col(right_at).alias("at_")).agg(F.min(right_id).alias("rid_")).select(*by, "at_", F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), "rid_", F.lit(0).alias("is_left_"))
    from pyspark.sql import Window

    w, so_far = Window.partitionBy(*by), (Window.unboundedPreceding, Window.currentRow)
    forth, back = w.orderBy("at_", "is_left_").rowsBetween(*so_far), w.orderBy(F.desc("at_"), F.desc("is_left_")).rowsBetween(*so_far)
    spot = F.when(F.col("is_left_") == 0, F.struct("at_", "rid_"))
    all_ = l.unionByName(r).withColumn("b_", F.last(spot, True).over(forth)).withColumn("a_", F.last(spot, True).over(back)).where("is_left_ = 1")
    far = lambda c: F.struct(F.abs(F.col("at_") - F.col(f"{c}.at_")).alias("distance"), F.col(f"{c}.rid_").alias("rid"))
    best = F.array_min(F.filter(F.array(F.when(F.col("b_").isNotNull(), far("b_")), F.when(F.col("a_").isNotNull(), far("a_"))), lambda x: x.isNotNull()))
    return all_.select(*by, left_id, best.alias("best")).where("best is not null").select(*by, left_id, F.col("best.rid").alias(right_id), F.col("best.distance").alias("distance"))


def in_interval(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Point in half-open interval. Both sides are dealt to cells of ``width``, so it is an equi-join with a filter."""
    cells = intervals.withColumn("cell_", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    met = points.withColumn("cell_", F.floor(F.col(at) / width)).join(cells, "cell_")
    return met.where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("cell_")


def close_pairs(a: DataFrame, b: DataFrame, by: list[str], radius: float) -> DataFrame:
    """Pairs of ``a(ax, ay)`` and ``b(bx, by_)`` within a distance: grid cells of the radius, so only neighbours meet."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    p = a.withColumn("n_", F.explode(near)).withColumn("cx_", F.floor(F.col("ax") / radius) + F.col("n_.i")).withColumn("cy_", F.floor(F.col("ay") / radius) + F.col("n_.j")).drop("n_")
    q = b.withColumn("cx_", F.floor(F.col("bx") / radius)).withColumn("cy_", F.floor(F.col("by_") / radius))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by_"))
    return p.join(q, [*by, "cx_", "cy_"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("cx_", "cy_")


def greedy_assignment(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One-to-one choice in order of ``(distance, a_id, b_id)`` within a group. The
    order makes it sequential, so each group is one Arrow batch; groups are pages."""
    schema = candidates.select(*by, "a_id", "b_id", "distance").schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        for row in pdf.sort_values(["distance", "a_id", "b_id"]).itertuples():
            if row.a_id not in left and row.b_id not in right:
                left.add(row.a_id)
                right.add(row.b_id)
                keep.append(row.Index)
        return pdf.loc[keep, schema.names]

    return candidates.select(*schema.names).groupBy(*by).applyInPandas(choose, schema)


def linked(markers: DataFrame, glyphs: DataFrame, rows: DataFrame, by: list[str], radius: float) -> DataFrame:
    """``(by, marker, ordinal, distance)`` of every marker, null where no link can be trusted.

    ``markers(marker, ax, ay, outcome)``, ``glyphs(glyph, bx, by_, ordinal, word,
    start, end, whole)`` and ``rows(ordinal, outcomes)``. A pair counts within the
    radius where the ordinal has a row and the row's outcomes hold the marker's.
    Pairs are taken in order of ``(distance, marker, glyph)``: whole glyphs first;
    of markers with one ordinal the nearest keeps it and the others are released;
    then parts too. Claims on one word must not overlap in ``[start, end)``, and
    a part never takes an ordinal that is held. Ordinals still held twice unlink.
    Only points go to a page's task, so it holds no more than the page has of them.
    """
    told = ["glyph", "bx", "by_", "outcome", "ordinal", "word", "start", "end", "whole"]
    known = lambda *xy: reduce(and_, (F.abs(F.col(c)) < float("inf") for c in xy))
    shown = glyphs.join(rows, [*by, "ordinal"]).withColumn("outcome", F.explode(F.array_distinct("outcomes"))).where(known("bx", "by_") & F.col("outcome").isNotNull()).select(*(F.col(c).alias(f"of_{c}") for c in by), *told)
    points = markers.where(known("ax", "ay") & F.col("outcome").isNotNull()).select(*by, "marker", "ax", "ay", "outcome")
    asked = ["marker", "ax", "ay", "outcome"]
    schema = StructType([*points.select(*by, "marker").schema, *shown.select("ordinal").schema, *(StructField(c, DoubleType()) for c in ("ax", "ay", "bx", "by_"))])

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = lambda pdf, columns: list(zip(*(pdf[c].tolist() for c in columns)))
        links = linking.choose(rows(left, asked), rows(right, told), radius)
        a, b = left.iloc[[m for m, _ in links]].reset_index(drop=True), right.iloc[[g for _, g in links]].reset_index(drop=True)
        return pd.concat([a[[*by, "marker", "ax", "ay"]], b[["ordinal", "bx", "by_"]]], axis=1)[schema.names]

    found = points.groupBy(*by).cogroup(shown.groupBy(*(f"of_{c}" for c in by))).applyInPandas(choose, schema)
    found = found.select(*by, "marker", "ordinal", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by_")).alias("distance"))
    return markers.select(*by, "marker").join(found, [*by, "marker"], "left")


def incident(edges: DataFrame, node: Column) -> DataFrame:
    """Edges with an end at the node."""
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree, weight)``: distinct neighbours and the weight of all edges at each node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("far")), F.struct(F.col("dst").alias("node"), F.col("src").alias("far")))).alias("e"), "weight")
    return ends.groupBy("e.node").agg(F.count_distinct("e.far").alias("degree"), F.sum("weight").cast("bigint").alias("weight"))
