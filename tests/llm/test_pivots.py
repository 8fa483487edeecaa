import math
import random

import numpy as np
import pytest

from tallymill.llm import pivots


def brute(rows):
    ok = [v is not None and len(v) and all(e is not None and math.isfinite(e) for e in v) and any(v) and i is not None for i, v in rows]
    links = {k: set() for k in range(len(rows))}
    x = [np.float32(v).astype(np.float64) if good else None for good, (_, v) in zip(ok, rows)]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / math.sqrt(x[a] @ x[a]) / math.sqrt(x[b] @ x[b]) >= 0.9:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        comp = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((i, len(links[k]), comp, i == comp))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(25)]
    rows = [(k, [c + rng.gauss(0, 0.08) for c in rng.choice(base)]) for k in range(220)]
    rows += [(300 + k, base[0]) for k in range(30)] + [(400, [0.0] * 16), (401, None), (402, []), (403, [1.0, None]), (404, [float("nan")] * 16), (405, [1.0, 2.0]), (406, [2.0, 4.1]), (None, base[0]), (300, base[0]), (407, [float("inf")] + [1.0] * 15), (408, [1e30] + [0.0] * 15)]
    df = spark.createDataFrame([(a, b, "x", 0) for a, b in rows], "vec_id long, embedding array<float>, n string, node int")
    want = brute(rows)
    for tile in (1024, 7):
        got = sorted((tuple(r) for r in pivots.near_duplicates(df, tile=tile).collect()), key=str)
        assert [r[0] for r in got] == [r[0] for r in want]
        total, found = sum(r[1] for r in want), sum(r[1] for r in got)
        assert found == total and got == want


def drawn(rng, n, dim, mean):
    """Unit vectors whose mean cosine is ``mean``."""
    way = np.zeros(dim)
    way[0] = 1
    return pivots.unit(math.sqrt(mean) * way + math.sqrt(1 - mean) * pivots.unit(rng.normal(size=(n, dim))))


@pytest.mark.parametrize("dim", [2, 8, 64, 384])
@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8])
def test_recall_on_the_edge(dim, mean):
    """Recall of retrieval for pairs at the threshold itself, in random directions and towards
    other vectors, that the setting has not seen; where no setting does, all pairs are compared."""
    rng = np.random.default_rng(0)
    x = drawn(rng, 5000, dim, mean)
    new = x[3500:]
    for classes, count in ((5000, 64), (5_000_000, 256), (500_000_000, 1023)):
        own = pivots.tuned(x[:3500], classes, most=count)
        if own is None:
            continue
        assert own.share <= pivots.MOST_SHARE
        for way in (rng.normal(size=new.shape), drawn(rng, len(new), dim, mean)):
            aside = way - (way * new).sum(1, keepdims=True) * new
            other = 0.9 * new + math.sqrt(1 - 0.9**2) * pivots.unit(aside)
            a, b = (pivots.nearest(pivots.seen_from(v, own.mean), own.pivots, own.depth) for v in (new, other))
            front, depth = pivots.meeting_places(a, b)
            assert ((front <= own.front) & (depth <= own.depth)).mean() >= 0.94, (classes, own)


def test_isotropic_and_centred_data_have_an_index_without_large_lists():
    rng = np.random.default_rng(1)
    for dim, mean in ((64, 0.0), (64, 0.5), (384, 0.0), (384, 0.5)):
        x = drawn(rng, 4000, dim, mean)
        own = pivots.tuned(x, 5_000_000)
        keys = pivots.list_keys(pivots.nearest(pivots.seen_from(x, own.mean), own.pivots, own.depth), own.front)
        assert np.unique(keys, return_counts=True)[1].max() <= 0.1 * len(x)


def test_a_pair_counts_on_one_list_only():
    rng = np.random.default_rng(2)
    x = drawn(rng, 300, 8, 0.0)
    x = pivots.unit(np.concatenate((x, x + 0.05 * rng.normal(size=x.shape))))
    near = pivots.nearest(x, drawn(rng, 40, 8, 0.0), 6)
    keys, counts = pivots.list_keys(near, 3), {}
    for key in np.unique(keys):
        at = np.flatnonzero((keys == key).any(axis=1))
        for i, j in zip(*pivots.links(x[at], near[at], 3, np.zeros(len(at), int), int(key), 0.9)):
            pair = tuple(sorted((at[i], at[j])))
            counts[pair] = counts.get(pair, 0) + 1
    meet = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] @ x[j] >= 0.9 and set(keys[i]) & set(keys[j])}
    assert set(counts) == meet and set(counts.values()) == {1}


@pytest.mark.parametrize("dim,mean", [(64, 0.0), (64, 0.5), (2, 0.0), (8, 0.5)])
def test_thousands_of_links_against_brute_force(spark, dim, mean):
    """Groups with cosines about the threshold: at least 0.95 of all links, none too many; all with ``exact``."""
    rng = np.random.default_rng(3)
    x = drawn(rng, 1500, dim, mean)
    part = np.float32(x[rng.integers(0, 150, 900)] + 0.33 * pivots.unit(rng.normal(size=(900, dim))))
    x = np.concatenate((np.float32(x), part))
    y = pivots.unit(x)
    want = (y @ y.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = np.array([r.n_links for r in sorted(pivots.near_duplicates(df).collect())])
    assert want.sum() > 2000 and (got <= want).all() and got.sum() >= 0.95 * want.sum()
    whole = np.array([r.n_links for r in sorted(pivots.near_duplicates(df, exact=True).collect())])
    assert (whole == want).all()


def test_many_lengths(spark):
    """Vectors meet those of their own length; lengths of few vectors have no index."""
    rng = np.random.default_rng(4)
    rows = [(100 * d + k, (np.ones(d) + 1e-3 * rng.normal(size=d)).tolist()) for d in range(2, 90) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pivots.near_duplicates(df).collect()
    assert len(got) == len(rows) and all(r.n_links == 1 and r.component_id == r.vec_id // 100 * 100 for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.near_duplicates(df).count() == 0
