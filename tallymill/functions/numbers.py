"""Numbers: rounding, axes, clocks, geometry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_decimal(c: Column, places: int) -> Column:
    """Half-even rounding of an exact decimal value."""
    return F.bround(c.cast("decimal(30,10)"), places).cast("double")


def round_exact(places: int):
    """Half-even rounding of the exact binary value (2.675 to 2.67). The JVM rounds
    the shortest decimal instead, so this one is a vectorised Python function."""

    @F.pandas_udf(T.DoubleType())
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else round(float(v), places))

    return rounded


def nice_step(span: Column, parts: int) -> Column:
    """The least 1-2-5 step that cuts the span into at most so many parts."""
    raw = F.greatest(span, F.lit(1e-9)) / parts
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    r = F.round(raw / unit, 9)
    return F.when(r <= 1, 1.0).when(r <= 2, 2.0).when(r <= 5, 5.0).otherwise(10.0) * unit


def axis_ticks(top: Column, parts: int) -> Column:
    """Ticks from zero to the first one at or above the top."""
    step = nice_step(top, parts)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.round(top / step, 9)).cast("int")), lambda k: k * step)


def count_step(top: Column, parts: int) -> Column:
    """The step of an axis of counts: whole, at least one."""
    return F.greatest(F.lit(1.0), F.round(nice_step(F.greatest(top.cast("double"), F.lit(1.0)), parts))).cast("bigint")


def count_axis_top(top: Column, parts: int) -> Column:
    """The first step at or above the top; never zero."""
    step = count_step(top, parts)
    return F.greatest(step, F.ceil(top / step) * step)


def peak_ticks(peak: Column, parts: int = 2) -> Column:
    """Ticks of a whole peak to both sides of zero. The peak has a tick: beyond the last
    step where it is half a step clear of it, else in its place."""
    high = F.greatest(peak.cast("bigint"), F.lit(1).cast("bigint"))
    step = count_step(high, parts)
    steps = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.floor(high / step), F.lit(1))), lambda k: k * step)
    steps = F.filter(steps, lambda t: (t <= high) & ((t == high) | ((high - t) * 2 >= step)))
    up = F.array_union(steps, F.array(high))
    return F.concat(F.reverse(F.transform(up, lambda t: -t)), F.array(F.lit(0).cast("bigint")), up)


def leader(a: Column, b: Column, direction: Column | str = "higher") -> Column:
    """home, away or tie; 'lower' swaps the sides, 'none' is a tie, null on either side is a tie."""
    way = F.lit(direction) if isinstance(direction, str) else direction
    first = F.when(way == "lower", a < b).otherwise(a > b)
    return F.when(a.isNull() | b.isNull() | (a == b) | (way == "none"), "tie").when(first, "home").otherwise("away")


def minute_stamp(c: Column) -> tuple[Column, Column]:
    """``90+2'`` as minute and stoppage."""
    p = r"^(\d+)(?:\+(\d+))?'?$"
    part = lambda k: F.nullif(F.regexp_extract(c, p, k), F.lit("")).cast("bigint")
    return part(1), part(2)


def clock_key(minute: Column, stoppage: Column) -> Column:
    return minute * 1000 + F.coalesce(stoppage, F.lit(0))


def minutes_played(on: Column, off: Column, length: Column) -> Column:
    """End less start; a substitute who never came on has played zero."""
    return F.greatest(F.lit(0), F.coalesce(off, length) - F.coalesce(on, F.lit(0)))


def to_pitch(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Page point to a pitch of 100 by 100 that is attacked upwards; small overshoots are clamped, larger ones are null."""
    px, py = 100 * (y1 - y) / (y1 - y0), 100 * (x - x0) / (x1 - x0)
    clamp = lambda v: F.when(v.between(-0.5, 100.5), F.least(F.lit(100.0), F.greatest(F.lit(0.0), v)))
    return clamp(px), clamp(py)


def share(part: Column, whole: Column, empty: float | None = None) -> Column:
    """Percentage; ``empty`` (null or 0) where the whole is zero."""
    return F.coalesce(F.try_divide(part * 100.0, F.nullif(whole, F.lit(0)).cast("double")), F.lit(empty).cast("double"))
