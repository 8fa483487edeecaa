"""Embedding near-duplicates with a pivot-permutation index.

Every vector is described by the order of its nearest reference points (pivots),
which are vectors of a bounded sample, seen from the sample's mean so that data that
crowd about a direction still spread over the pivots. Of a vector's ``K`` nearest
pivots the first ``R`` are its front. Inverted lists hold, for a front pivot and
another pivot, the vectors that have the two in these places: vectors that meet share
a front pivot and at least two pivots. On a list all pairs are verified by cosine in
double precision; a pair on several lists counts on the first list the two share
only, which the pivots they share tell without any look-up.

How many pivots, which of two ways of drawing them, ``R`` and ``K`` are the index's
``Setting``, fitted for each vector length (``tuned``): of the settings that retrieve
``TARGET`` of the sample's pairs at the threshold (in random directions, towards other
vectors, and pairs the sample itself holds), the one with the least expected work.
Where none does, all pairs of that length are compared in tiles, as they are where the
caller asks for ``exact``, where a length has at most ``FEW`` classes, and for lengths
beyond the ``LENGTHS`` most frequent; so what is broadcast is bounded by ``LENGTHS``
times ``MAX_PIVOTS`` vectors.

Equal vectors are one class before the index, so exact copies cost nothing; a
list of over ``TILE`` classes is cut by a salt, and each pair of cuts meets in a
group of its own. Rows whose pivots show at once that they have met on an earlier list
are not compared again, so a crowd of near copies is compared once. Links leave a group as counts and a spanning forest (linear
rows), never as pairs. The index is approximate; every link it gives is exact.

Defined results: null, empty or zero vectors, those with null or non-finite
components and those of null ids link with nothing (``n_links`` 0, their own
component); vectors of different lengths never link; rows that repeat an id
each get a row and, with equal vectors, link as copies; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import components, forest, materialize
from tallymill.llm.labelled import low_hashes

COSINE = 0.9
MIN_PIVOTS, MAX_PIVOTS = 32, 2048
#: Vectors of a length that its pivots and its setting are chosen from.
SAMPLE = 8192
#: Share of the sample's pairs at the threshold that a setting has to retrieve, and of
#: those at least halfway from there to copies.
TARGET, TARGET_NEAR = 0.96, 0.998
#: Pairs of each kind, and vectors, that a setting is measured on.
PROBES, WATCHED = 800, 3000
FRONTS, DEPTHS = (1, 2, 3, 4, 6, 8, 12, 16), (3, 4, 6, 8, 12, 16, 24, 32, 48)
#: Most inverted lists a vector may be on.
POSTINGS = 600
#: Compares over all pairs beyond which an index is not worth its name, and the share of
#: the vectors on one list that a setting should not pass if another one can do without.
MOST_SHARE, LARGEST = 0.6, 0.1
#: Work of one posting in multiplications of a cosine.
POSTING_WORK = 10_000
#: Classes of a length up to which no index is made; lengths that have one.
FEW, LENGTHS = 64, 64
TILE = 1024
_ALL = (1 << 24) - 1  # the one list of a length without an index


@dataclass(frozen=True)
class Setting:
    mean: np.ndarray
    pivots: np.ndarray
    front: int
    depth: int
    recall: float
    #: Expected compares over all pairs.
    share: float


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision with length 1; safe for very large and small values."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def seen_from(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Directions of unit rows ``x`` from ``mean``; of rows that lie on it, their own."""
    y = x - mean
    length = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return np.where(length > 1e-12, y / np.maximum(length, 1e-12), x)


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Numbers of ``count`` rows, each farthest from those before it; fewer if no more differ."""
    chosen, at = [], 0
    near = np.full(len(x), -2.0)
    while len(chosen) < min(count, len(x)):
        chosen.append(at)
        near = np.maximum(near, x @ x[at])
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break
    return np.array(chosen, np.int64)


def nearest(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the nearest pivots of rows ``x``, nearest first."""
    like = x @ pivots.T
    if depth >= len(pivots):
        return np.argsort(-like, axis=1, kind="stable")
    top = np.argpartition(-like, depth - 1, axis=1)[:, :depth]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(like, top, 1), axis=1, kind="stable"), 1)


def probes(x: np.ndarray, cosine: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Pairs of unit vectors and the share of them to be retrieved: pairs at the threshold and
    halfway from it to copies, in random directions and towards other rows, and the pairs that
    ``x`` itself holds."""
    at = x[rng.integers(0, len(x), PROBES)]
    kinds = []
    for way in (rng.normal(size=at.shape), x[rng.integers(0, len(x), PROBES)]):
        aside = way - (way * at).sum(axis=1, keepdims=True) * at
        length = np.sqrt((aside * aside).sum(axis=1))
        ok = length > 1e-6
        for c, target in ((cosine, TARGET), ((1 + cosine) / 2, TARGET_NEAR)):
            kinds.append((at[ok], c * at[ok] + (1 - c**2) ** 0.5 * aside[ok] / length[ok, None], target))
    some = x[:WATCHED]
    like = some @ some.T
    for low, high, target in ((cosine, (1 + cosine) / 2, TARGET), ((1 + cosine) / 2, 2, TARGET_NEAR)):
        i, j = np.nonzero((like >= low) & (like < high))
        i, j = i[i < j], j[i < j]
        if len(i) >= 100:
            pick = rng.permutation(len(i))[: 2 * PROBES]
            kinds.append((some[i[pick]], some[j[pick]], target))
    return [k for k in kinds if len(k[0])]


def meeting_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of permutations, the least front and the least depth at which they share
    a first and a second pivot; beyond all depths where they do not."""
    first, second = (np.full(len(a), 1 << 20) for _ in range(2))
    for s in range(0, len(a), 256):
        same = a[s : s + 256, :, None] == b[s : s + 256, None, :]
        place = np.maximum.outer(np.arange(a.shape[1]), np.arange(b.shape[1])) + 1
        two = np.partition(np.where(same, place, 1 << 20).reshape(len(same), -1), 1, axis=1)
        first[s : s + 256], second[s : s + 256] = two[:, 0], two[:, 1]
    return first, second


def list_keys(near: np.ndarray, front: int) -> np.ndarray:
    """Inverted lists of each row: a pivot of its front, and any other pivot."""
    f, o = (i.ravel() for i in np.meshgrid(np.arange(front), np.arange(near.shape[1]), indexing="ij"))
    f, o = f[f != o], o[f != o]
    return (near[:, f].astype(np.int64) << 12) | near[:, o]


def earlier(near: np.ndarray, front: int, lead: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What shows, for each row on the list of pivots ``(lead, other)``, that it meets any row of
    the same mark on an earlier list: a lower front pivot, or else a lower second one; -1 if none."""
    low = near[:, :front].min(axis=1, initial=4096, keepdims=True).astype(np.int64)
    two = np.partition(near, 1, axis=1)[:, :2].astype(np.int64) if near.shape[1] > 1 else np.full((len(near), 2), 4096)
    second = np.where(two[:, :1] == lead, two[:, 1:], two[:, :1])
    return np.where(low < lead, low, np.where(second < other, 4096 + second, -1))


def tuned(sample: np.ndarray, classes: int, cosine: float = COSINE, most: int | None = None) -> Setting | None:
    """The setting with the least expected work for ``classes`` vectors like ``sample`` that
    retrieves enough of each kind of probe, one without large lists first; None where
    none does at a part of all compares."""
    rng = np.random.default_rng(11)
    x = unit(sample)
    x = x[rng.permutation(len(x))]
    mean = x.mean(axis=0)
    most = most or int(min(MAX_PIVOTS, max(MIN_PIVOTS, 1.1 * classes**0.5)))
    y = seen_from(x, mean)
    best, least = None, (True, np.inf)
    for order in (np.arange(min(most, len(y))), spread(y, most)):
        rest = np.setdiff1d(np.arange(len(y)), order)
        rest = rest if len(rest) >= 32 else np.arange(len(y))
        pairs = [(seen_from(a, mean), seen_from(b, mean), target) for a, b, target in probes(x[rest], cosine, np.random.default_rng(12))]
        watched = y[rest][:WATCHED]
        size = len(order)
        while size >= 4:
            p = y[order[:size]]
            depth = min(max(DEPTHS), size)
            met = [(*meeting_places(nearest(a, p, depth), nearest(b, p, depth)), target) for a, b, target in pairs]
            near = nearest(watched, p, depth)
            for front in FRONTS:
                ok = [k for k in DEPTHS if front <= k <= depth and front * (k - 1) <= POSTINGS and all(((one <= front) & (two <= k)).mean() >= target for one, two, target in met)]
                if not ok:
                    continue
                k = min(ok)
                lists = list_keys(near[:, :k], front)
                mark = earlier(near[:, :k], front, lists >> 12, lists & 4095)
                n = np.unique(lists, return_counts=True)[1].astype(np.float64)
                passed = np.unique((lists << 14 | mark)[mark >= 0], return_counts=True)[1].astype(np.float64)
                share = float(((n * (n - 1)).sum() - (passed * (passed - 1)).sum()) / max(1, len(near) * (len(near) - 1)))
                if share > MOST_SHARE:
                    continue
                work = classes**2 / 2 * share * x.shape[1] + classes * (front * (k - 1) * POSTING_WORK + size * x.shape[1])
                rated = (bool(n.max() > LARGEST * len(near)), work)
                if rated < least:
                    least = rated
                    best = Setting(mean, p, front, k, min(float(((one <= front) & (two <= k)).mean()) for one, two, _ in met), share)
            size //= 2
    return best


def links(x: np.ndarray, near: np.ndarray, front: int, side: np.ndarray, key: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list that link and are on no earlier common list: they share
    no lower front pivot than the list's, and of the other pivots none below its second."""
    left, right = [], []
    lead, other = key >> 12, key & 4095
    none = -1 - np.arange(near.shape[1])  # meets nothing
    mark = earlier(near, front, np.int64(lead), np.int64(other)).ravel() if front else np.full(len(x), -1)
    order = np.argsort(-mark, kind="stable")  # those without a mark last
    x, near, side, mark = x[order], near[order], side[order], mark[order]
    before = np.where(near[:, :front] < lead, near[:, :front], none[:front])
    others = np.where((near < other) & (near != lead), near, none)
    ends = np.append(np.flatnonzero(np.diff(mark)) + 1, len(x))
    at = 0
    while at < len(x):
        # rows of one mark have met: they are compared with the rows after them, and with each other only without one
        end = int(ends[np.searchsorted(ends, at, "right")])
        stop = min(end, at + 512)
        begin = at if mark[at] < 0 else end
        like = x[at:stop] @ x[begin:].T
        i, j = np.nonzero(like >= cosine - 1e-9)
        i, j = i + at, j + begin
        ok = i < j
        i, j = i[ok], j[ok]
        for part in range(0, len(i), 1 << 18):
            a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            ok = (side[a] == 0) | (side[a] != side[b])
            a, b = a[ok], b[ok]
            for pivots in (before, others):
                shared = np.zeros(len(a), bool)
                for k in range(pivots.shape[1]):
                    one = pivots[a, k]
                    at_all = np.flatnonzero(one >= 0)
                    shared[at_all] |= (one[at_all, None] == pivots[b[at_all]]).any(axis=1)
                a, b = a[~shared], b[~shared]
            close = np.abs(like[a - at, b - begin] - cosine) < 1e-9
            if close.any():  # settle the edge by one exact summation order
                exact = np.array([float(np.dot(x[p], x[q])) for p, q in zip(a[close], b[close])])
                keep = np.ones(len(a), bool)
                keep[np.flatnonzero(close)[exact < cosine]] = False
                a, b = a[keep], b[keep]
            left.append(order[a])
            right.append(order[b])
        at = stop
    empty = np.zeros(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tile: int = TILE, exact: bool = False) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``vectors``; with ``exact``
    all pairs are compared, tile by tile, and no link is lost."""
    spark = vectors.sparkSession
    v = F.col("v")
    usable = (
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.select("id", "v", F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    grouped = rows.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "head", "n", "v"), "vector-classes")

    # the most frequent vector lengths; each has a bounded sample and a setting
    lengths = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > FEW).orderBy(F.desc("n"), "d").limit(0 if exact else LENGTHS).collect()
    fitted: dict[int, Setting] = {}
    for d, have in lengths:
        got = classes.where((F.size("v") == d) & low_hashes(F.col("h1"), SAMPLE, have)).orderBy("h1", "h2").limit(SAMPLE).select("v").collect()
        setting = tuned(np.array([r.v for r in got], np.float64).reshape(len(got), d), have, cosine)
        if setting is not None:
            fitted[d] = setting
    settings = spark.sparkContext.broadcast(fitted)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one length, their vectors, nearest pivots and lists."""
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                column = batch.column(2)
                sizes = column.value_lengths().to_numpy()
                flat = column.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    raw = flat[starts[at][:, None] + np.arange(d)]
                    near, keys = np.zeros((len(at), 0), np.int16), np.full((len(at), 1), _ALL, np.int64)
                    if (own := settings.value.get(int(d))) is not None:
                        near = nearest(seen_from(unit(raw), own.mean), own.pivots, own.depth).astype(np.int16)
                        keys = list_keys(near, own.front)
                    yield batch, at, raw, near, (int(d) << 24) | keys

    def sizes_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, keys in described(batches):
            key, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "crowd"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each inverted list of each class."""
        for batch, at, raw, near, keys in described(batches):
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            k = keys.shape[1]
            packed, marks = [r.tobytes() for r in raw], [r.tobytes() for r in near]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel()), pa.array(np.repeat(node[at], k)), pa.array(np.repeat(n[at], k)),
                    pa.array([m for m in marks for _ in range(k)], pa.binary()), pa.array([p for p in packed for _ in range(k)], pa.binary()),
                ],
                names=["key", "node", "n", "near", "raw"],
            )

    vectors_of = classes.select("node", "n", "v")
    posted = vectors_of.mapInArrow(post, "key long, node long, n long, near binary, raw binary")
    crowded = vectors_of.mapInArrow(sizes_of_lists, "key long, crowd long").groupBy("key").agg(F.sum("crowd").alias("crowd")).where(F.col("crowd") > tile)
    cuts = F.coalesce(F.ceil(F.col("crowd") / F.lit(tile)).cast("int"), F.lit(1))
    salt = F.pmod(F.xxhash64("node"), cuts).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), cuts - 1),
        lambda t: F.struct(F.least(t, salt).alias("t0"), F.greatest(t, salt).alias("t1"), F.when(t == salt, 0).when(salt < t, 1).otherwise(2).cast("int").alias("side")),
    )
    dealt = posted.join(crowded, "key", "left").select("key", "node", "n", "near", "raw", F.explode(meets).alias("m"))
    dealt = dealt.select("key", F.col("m.t0"), F.col("m.t1"), F.col("m.side"), "node", "n", "near", "raw")
    lists = dealt.repartition("key", "t0", "t1").sortWithinPartitions("key", "t0", "t1")
    wide = dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"] == "array<double>"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(rows: list[tuple]) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            key, side = rows[0][0], np.array([r[3] for r in rows])
            node, n = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
            near = np.frombuffer(b"".join(r[6] for r in rows), np.int16).reshape(len(rows), len(rows[0][6]) // 2)
            own = settings.value.get(key >> 24)
            x = unit(np.frombuffer(b"".join(r[7] for r in rows), np.float64 if wide else np.float32).reshape(len(rows), -1))
            i, j = links(x, near, own.front if own else 0, side, key & _ALL, cosine)
            if not len(i):
                return None
            linked = np.bincount(i, n[j], len(rows)) + np.bincount(j, n[i], len(rows))
            label = forest(i, j, len(rows))
            at = np.flatnonzero(linked)
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(linked[at].astype(np.int64)), pa.array(node[label[at]])], names=["node", "linked", "root"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    if (out := group(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if (out := group(held)) is not None:
            yield out

    found = materialize(lists.mapInArrow(verify, "node long, linked long, root long"), "vector-links")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    named = classes.drop("v").join(total, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("head").alias("component_id"))
    final = named.join(heads, "component").select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("usable"))
    return (
        rows.select("id", "usable", "h1", "h2").join(final, ["h1", "h2", "usable"], "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
