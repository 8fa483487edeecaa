"""Connected points, and clusters that merge until their centres are apart.

No task holds a page: points meet in grid cells, components are found on edges, and
each round of merging is a few joins and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.sources.staging import Staging


def connected(edges: DataFrame, staging: Staging) -> DataFrame:
    """``(node, label)`` of every node of the edges ``(a, b)`` that has another one for a
    neighbour; the label is the smallest node it reaches.

    Each round lets every label follow its smallest neighbour, twice and twice again, and
    keeps only the edges between labels that still differ; these at least halve.
    """
    left = staging.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = staging.keep(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not left.isEmpty():
        ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("from_"), F.least("a", "m").alias("to_"))
        for _ in range(2):
            further = step.select(F.col("from_").alias("to_"), F.col("to_").alias("then_"))
            step = step.join(further, "to_", "left").select("from_", F.coalesce("then_", "to_").alias("to_"))
        step = staging.keep(step, "steps")
        old = left, labels
        labels = staging.keep(labels.join(step, F.col("label") == F.col("from_"), "left").select("node", F.coalesce("to_", "label").alias("label")), "labels")
        a, b = (step.select(F.col("from_").alias(c), F.col("to_").alias(f"{c}_to")) for c in ("a", "b"))
        met = left.join(a, "a").join(b, "b").where("a_to <> b_to")
        left = staging.keep(met.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        for t in (*old, step):
            staging.drop(t)
    staging.drop(left)
    return labels


def _apart(a0: str, a1: str, b0: str, b1: str) -> tuple[Column, Column]:
    """Least and greatest distance of two intervals."""
    c = F.col
    return F.greatest(F.lit(0.0), c(b0) - c(a1), c(a0) - c(b1)), F.greatest(c(b1) - c(a0), c(a1) - c(b0))


def close_links(points: DataFrame, by: str, radius: float, staging: Staging) -> DataFrame:
    """Edges ``(a, b)`` between points ``(by, node, x, y)`` whose components are those of
    all pairs closer than the radius.

    Cells of half a radius: points of one cell are surely close, so each hangs on the cell's
    smallest. Two cells whose bounding boxes lie closer than the radius from corner to
    corner are linked as a whole; where the boxes leave it open and no other way joins the cells,
    their points are compared. So the edges grow with the points, however dense.
    """
    side, limit = radius / 2, F.lit(float(radius) * float(radius))
    celled = points.select(by, "node", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    box = [F.min("node").alias("head"), *(f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max)))]
    boxes = staging.keep(celled.groupBy(by, "cx", "cy").agg(*box), "cells")
    ahead = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)))
    q = boxes.select(by, F.col("cx").alias("nx"), F.col("cy").alias("ny"), *(F.col(c).alias(f"q{c}") for c in ("head", "x0", "x1", "y0", "y1")))
    near = boxes.withColumn("to_", F.explode(ahead)).withColumn("nx", F.col("cx") + F.col("to_.i")).withColumn("ny", F.col("cy") + F.col("to_.j"))
    (gx, fx), (gy, fy) = (_apart(f"{c}0", f"{c}1", f"q{c}0", f"q{c}1") for c in "xy")
    met = near.join(q, [by, "nx", "ny"]).where(gx * gx + gy * gy < limit).withColumn("sure", fx * fx + fy * fy < limit)
    met = staging.keep(met.select(by, "cx", "cy", "nx", "ny", "head", "qhead", "sure"), "cell-pairs")
    inner = celled.join(boxes.select(by, "cx", "cy", "head"), [by, "cx", "cy"]).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    sure = met.where("sure").select(F.col("head").alias("a"), F.col("qhead").alias("b"))
    found = connected(sure, staging)
    own, other = (found.select(F.col("node").alias(c), F.col("label").alias(f"{c}_l")) for c in ("head", "qhead"))
    doubt = met.where("not sure").join(own, "head", "left").join(other, "qhead", "left")
    doubt = doubt.where(F.coalesce("head_l", "head") != F.coalesce("qhead_l", "qhead")).select(by, "cx", "cy", "nx", "ny", "head", "qhead")
    second = celled.select(by, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    tried = doubt.join(celled.select(by, "cx", "cy", "x", "y"), [by, "cx", "cy"]).join(second, [by, "nx", "ny"])
    tried = tried.where(dx * dx + dy * dy < limit).select(F.col("head").alias("a"), F.col("qhead").alias("b")).distinct()
    return inner.unionByName(sure).unionByName(tried)


def merge_until_apart(points: DataFrame, by: str, radius: float, unit: int = 1000) -> DataFrame:
    """``(by, id, cluster)`` of points ``(by, id, x, y)``, ids being their own in the whole table.

    Points that are joined by steps shorter than the radius are a cluster; then clusters
    whose centres are closer than the radius are one, round after round, until no two
    are. A cluster is named by its smallest id. All that are joined in a round merge at once,
    so the result does not depend on an order. Coordinates count in whole ``1 / unit``,
    so centres are the same however rows are dealt.
    """
    staging = Staging(points.sparkSession)
    at = [F.round(F.col(c) * unit).cast("long").alias(c) for c in "xy"]
    own = staging.keep(points.select(by, F.col("id").cast("long").alias("id"), *at), "points")
    member = own.select(by, "id", F.col("id").alias("cluster"))
    while True:
        centre = own.join(member, [by, "id"]).groupBy(by, "cluster").agg(*((F.sum(c) / F.count("*")).alias(c) for c in "xy")).withColumnRenamed("cluster", "node")
        centre = staging.keep(centre, "centres")
        labels = connected(close_links(centre, by, radius * unit, staging), staging)
        before, over = member, labels.isEmpty()
        if not over:
            moved = member.join(labels, F.col("cluster") == F.col("node"), "left")
            member = staging.keep(moved.select(by, "id", F.coalesce("label", "cluster").alias("cluster")), "members")
        staging.clear(own, member, before)
        if over:
            out = staging.keep(member, "clusters")
            staging.clear(out)
            return out
        staging.drop(before)
