"""Marks on a page: frames, candidates, keys, values above labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.sources.staging import Staging


def largest(rects: DataFrame, by: list[str], area: Column, id_col: str, lo: float, hi: Column | float) -> DataFrame:
    """The largest rectangle of a page with an area between the bounds; ties to the lower id."""
    top = hi if isinstance(hi, Column) else F.lit(hi)
    fit = rects.withColumn("area", area).where((F.col("area") > lo) & (F.col("area") < top))
    return fit.groupBy(*by).agg(F.max(F.struct("area", (-F.col(id_col)).alias("k"))).alias("m")).select(*by, (-F.col("m.k")).alias(id_col), F.col("m.area").alias("area"))


def inside(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float], margin: float) -> DataFrame:
    """Points within a box and its margin."""
    x0, y0, x1, y1 = box
    return points.where(F.col(x).between(x0 - margin, x1 + margin) & F.col(y).between(y0 - margin, y1 + margin))


def keyed(marks: DataFrame, key: DataFrame, on: str, value: str) -> DataFrame:
    """Marks with the meaning of their colour; a colour without one fails the query. The key is a
    legend of a few rows and goes to the marks: dealt by colour they would lie in as many tasks as it has colours."""
    met = marks.join(F.broadcast(key.withColumn("hit_", F.lit(True))), on, "left")
    return met.withColumn(value, F.when(F.col("hit_"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("colour without meaning: "), F.col(on).cast("string"))))).drop("hit_")


#: Values of a cell of the first round.
CELL = 8


def value_above(labels: DataFrame, values: DataFrame, by: list[str], side: float, rise: float) -> DataFrame:
    """For each label ``(label, x, y)`` the nearest value ``(value, x, y)`` straight
    above it: centres within ``side``, at most ``rise`` higher.

    Strips of ``side`` are cut into cells so low that each holds a few values, however many there are. A
    label looks into its own cell and the next above, in its own and both neighbouring strips: what it
    finds there is nearer than all beyond. Those that find nothing look again into cells four
    times as high, until two cells reach beyond ``rise``. Points in one place look, and are found, once.
    """
    staging = Staging(labels.sparkSession)
    strip = lambda x: F.floor(F.col(x) / side)
    spots = values.groupBy(*by, F.col("x").alias("vx"), F.col("y").alias("vy")).agg(F.min("value").alias("value")).where("vx is not null and vy is not null")
    spots = staging.keep(spots.withColumn("strip_", strip("vx")), "spots")
    n, low, high = spots.agg(F.count("*"), F.min("vy"), F.max("vy")).first()
    strips = spots.select(*by, "strip_").distinct().count()
    height = (high - low) * CELL * strips / n if n and high > low else rise
    height = max(min(height, 1.001 * rise), rise / 2**40)
    live = staging.keep(labels.select(*by, F.col("x").alias("lx"), F.col("y").alias("ly")).distinct(), "labels")
    met = []
    while n:
        cell = lambda y: F.floor(F.col(y) / height)  # noqa: B023, E731
        near = F.explode(F.array(*(F.struct((strip("lx") + i).alias("strip_"), (cell("ly") + j).alias("cell_")) for i in (-1, 0, 1) for j in (0, 1))))
        pairs = live.select(*by, "lx", "ly", near.alias("at_")).select(*by, "lx", "ly", "at_.*").join(spots.withColumn("cell_", cell("vy")), [*by, "strip_", "cell_"])
        pairs = pairs.where((F.abs(F.col("lx") - F.col("vx")) <= side) & (F.col("vy") > F.col("ly")) & (F.col("vy") - F.col("ly") <= rise))
        best = F.min(F.struct((F.col("vy") - F.col("ly")).alias("d"), "value"))
        met.append(staging.keep(pairs.groupBy(*by, "lx", "ly").agg(best.alias("m")).select(*by, "lx", "ly", "m.value"), "met"))
        if height >= 1.001 * rise:
            break
        height = min(height * 4, 1.001 * rise)
        rest = staging.keep(live.join(met[-1], [*by, "lx", "ly"], "left_anti"), "labels")
        staging.drop(live)
        live = rest
    found = reduce(DataFrame.unionByName, met) if met else spots.select(*by, F.col("vx").alias("lx"), F.col("vy").alias("ly"), "value")
    out = staging.keep(labels.withColumnsRenamed({"x": "lx", "y": "ly"}).join(found, [*by, "lx", "ly"]).select(*by, "label", "value"), "values")
    staging.clear(out)
    return out
