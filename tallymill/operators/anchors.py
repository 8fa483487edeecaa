"""Groups that open at a row and hold what lies within a tolerance of that first row.

Such a fold is sequential: where a group opens depends on where the one before did. To
spread a page over tasks the sorted rows are cut into chunks. For its first and its last
page, which may go on in other chunks, a chunk says for every row that could open the first new
group where its last group would then open and how many it would open; a few numbers. These
are followed from chunk to chunk within a page, and then each chunk is folded with what it
is handed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.sources.staging import Staging

#: Rows of a chunk.
CHUNK = 10_000


def _openings(y: np.ndarray, tolerance: float) -> np.ndarray:
    """For each of the sorted values the place of the first one beyond its tolerance."""
    after = np.searchsorted(y, y + tolerance, "right")
    # the rule compares a difference, which may round otherwise than the sum
    n = len(y)
    while True:
        back = (after > np.arange(n) + 1) & (y[np.maximum(after - 1, 0)] - y > tolerance)
        forth = (after < n) & ~(y[np.minimum(after, n - 1)] - y > tolerance)
        if not (back.any() or forth.any()):
            return after
        after = after - back + (forth & ~back)


def _outcomes(y: np.ndarray, tolerance: float) -> list[tuple[float, float, int]]:
    """``(upto, anchor, opened)``: if the first new group opens at a value up to ``upto``
    (and beyond the one before), the last opens at ``anchor``, the ``opened``-th."""
    after, n = _openings(y, tolerance), len(y)
    last, count = np.zeros(n, np.int64), np.ones(n, np.int64)
    for j in range(n - 1, -1, -1):
        k = after[j]
        last[j], count[j] = (j, 1) if k == n else (last[k], count[k] + 1)
    first = int(np.searchsorted(y - y[0] > tolerance, True)) + 1  # beyond it no row can be the first to open
    out: list[tuple[float, float, int]] = []
    for j in range(min(first, n)):
        if out and out[-1][1:] == (y[last[j]], count[j]):
            out[-1] = (y[j], *out[-1][1:])
        else:
            out.append((y[j], y[last[j]], int(count[j])))
    return out


def _fold(y: np.ndarray, tolerance: float, anchor: float | None, opened: int) -> np.ndarray:
    """Number of each value's group, from the group that is open and its number."""
    after, n = _openings(y, tolerance), len(y)
    out = np.full(n, opened, np.int64)
    j = 0 if anchor is None else int(np.searchsorted(y - anchor > tolerance, True))
    while j < n:
        opened += 1
        out[j : after[j]] = opened
        j = int(after[j])
    return out


def anchored_groups(df: DataFrame, by: list[str], value: str, item: str, tolerance: float, name: str = "row", chunk: int = CHUNK) -> DataFrame:
    """``(by, value, item, name)``: within ``by`` rows go by ``value``; a new group starts
    where it exceeds the *first* value of the current group by more than the tolerance.

    Rows are dealt by range, so a page may lie in any number of tasks; rows without
    a value are left out.
    """
    staging = Staging(df.sparkSession)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value), item)
    dealt = rows.repartitionByRange(*by, value, item).sortWithinPartitions(*by, value, item)
    # the id counts rows within a partition from a multiple of 2^33 on
    dealt = staging.keep(dealt.withColumn("n_", F.monotonically_increasing_id()).withColumn("chunk_", F.floor(F.col("n_") / chunk)), "dealt")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*by).schema)

    def runs(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        """Where each page of a sorted chunk starts and ends."""
        new = np.zeros(len(pdf), np.bool_)
        for c in by:
            v, empty = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
            new[1:] |= ((v[1:] != v[:-1]) & ~(empty[1:] & empty[:-1])).astype(np.bool_)
        starts = [0, *np.flatnonzero(new).tolist()]
        return list(zip(starts, [*starts[1:], len(pdf)]))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_", ignore_index=True)
        found, y = runs(pdf), pdf[value].to_numpy()
        ends = found if len(found) < 2 else [found[0], found[-1]]
        said = [list(map(list, zip(*_outcomes(y[s:e], tolerance)))) for s, e in ends]
        out = pdf.loc[[s for s, _ in ends], [*by, "chunk_"]].reset_index(drop=True)
        return out.assign(**{c: [x[k] for x in said] for k, c in enumerate(("upto_", "anchor_", "opened_"))})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, opened, out = None, 0, []
        pdf = pdf.sort_values("chunk_")
        for row in pdf.itertuples():
            out.append((anchor, opened))
            upto = np.array(row.upto_)
            at = 0 if anchor is None else int(np.searchsorted(upto - anchor > tolerance, True))
            if at < len(upto):
                anchor, opened = row.anchor_[at], opened + row.opened_[at]
        pdf["from_"], pdf["before_"] = zip(*out)
        return pdf[[*by, "chunk_", "from_", "before_"]].astype({"from_": "float64"})

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_", ignore_index=True)
        y, handed, before = pdf[value].to_numpy(), pdf["from_"].to_numpy(), pdf["before_"].fillna(0).to_numpy()
        found = [_fold(y[s:e], tolerance, None if np.isnan(handed[s]) else handed[s], int(before[s])) for s, e in runs(pdf)]
        return pdf[[*by, value, item]].assign(**{name: np.concatenate(found)})

    said = dealt.groupBy("chunk_").applyInPandas(summary, f"{keys}, chunk_ long, upto_ array<double>, anchor_ array<double>, opened_ array<long>")
    handed = staging.keep(said.groupBy(*by).applyInPandas(follow, f"{keys}, chunk_ long, from_ double, before_ long"), "handed")
    same = F.col("d.chunk_") == F.col("h.chunk_")
    for c in by:
        same &= F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}"))
    met = dealt.alias("d").join(handed.alias("h"), same, "left").select("d.*", "from_", "before_")
    kind = dealt.schema[item].dataType.simpleString()
    out = staging.keep(met.groupBy("chunk_").applyInPandas(number, f"{keys}, {value} double, {item} {kind}, {name} long"), "rows")
    staging.clear(out)
    return out
