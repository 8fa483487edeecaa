"""Operators that spread one page over many tasks, against loops over a page."""

import math
import random

import numpy as np
import pytest

from tallymill.operators import anchors, clusters
from tallymill.sources.staging import Staging


def plain_rows(values, tolerance):
    out, anchor, n = [], None, 0
    for v in sorted(values):
        if anchor is None or v - anchor > tolerance:
            anchor, n = v, n + 1
        out.append((v, n))
    return out


def test_anchored_rows_in_any_chunks(spark):
    rng = random.Random(3)
    for trial, chunk in ((0, 3), (1, 7), (2, 50)):
        rows = [(page, round(rng.uniform(0, 30 if page else 400), rng.choice([1, 2, 9])), k) for k in range(400) for page in (rng.choice([0, 0, 0, 1, None]),)]
        rows += [(5, 1.0, 9000 + k) for k in range(20)] + [(6, None, 9999)]
        df = spark.createDataFrame(rows, "page int, y double, id long").repartition(4)
        got = anchors.anchored_groups(df, ["page"], "y", "id", 2.0, chunk=chunk).collect()
        for page in (0, 1, None, 5):
            assert sorted((r.y, r["row"]) for r in got if r.page == page) == plain_rows([y for p, y, _ in rows if p == page and y is not None], 2.0), (trial, page)
        assert len(got) == sum(y is not None for _, y, _ in rows)


def test_anchored_rule_compares_the_difference():
    """The sum of a value and the tolerance may round past what the difference says."""
    rng = random.Random(8)
    for _ in range(300):
        tol = rng.choice([0.1, 0.3, 2.0])
        y = np.sort(np.array([rng.randint(0, 40) * 0.1 + rng.choice([0, 1e-16, 3e-16]) for _ in range(rng.randint(1, 30))]))
        want = [next((k for k in range(j + 1, len(y)) if y[k] - y[j] > tol), len(y)) for j in range(len(y))]
        assert anchors._openings(y, tol).tolist() == want


def test_anchored_plan_collects_no_page(spark):
    df = spark.createDataFrame([(1, 0.0, 1)], "p int, y double, i long")
    assert "collect_list" not in anchors.anchored_groups(df, ["p"], "y", "i", 2.0)._jdf.queryExecution().toString()


def plain_clusters(points, radius):
    """Components of close points, then components of close centres until none are close."""
    groups = [[p] for p in sorted(points)]
    while True:
        centre = [(sum(p[1] for p in g) / len(g), sum(p[2] for p in g) / len(g)) for g in groups]
        label = list(range(len(groups)))
        changed = True
        while changed:
            changed = False
            for i in range(len(groups)):
                for j in range(i):
                    if label[i] != label[j] and (centre[i][0] - centre[j][0]) ** 2 + (centre[i][1] - centre[j][1]) ** 2 < radius * radius:
                        low, high = sorted((label[i], label[j]))
                        label = [low if x == high else x for x in label]
                        changed = True
        merged = {}
        for g, x in zip(groups, label):
            merged.setdefault(x, []).extend(g)
        if len(merged) == len(groups):
            return {p[0]: min(q[0] for q in g) for g in groups for p in g}
        groups = [sorted(g) for g in merged.values()]


def test_clusters_merge_in_rounds(spark):
    rng = random.Random(4)
    # 1 and 2 join; their centre nears 3; the next centre nears 4: three rounds
    chain = [(1, 0, 0), (2, 1000, 0), (3, 500, 9990), (4, -9400, 4000)]
    pages = {0: chain, 1: [(100 + k, rng.randint(0, 60_000), rng.randint(0, 60_000)) for k in range(70)], 2: [(300 + k, 5000, 5000) for k in range(5)] + [(305, 90_000, 5000)]}
    rows = [(page, i, x / 1000, y / 1000) for page, points in pages.items() for i, x, y in points]
    got = clusters.merge_until_apart(spark.createDataFrame(rows, "page int, id long, x double, y double"), "page", 10.0)
    assert {r.id: r.cluster for r in got.collect()} == {i: c for points in pages.values() for i, c in plain_clusters(points, 10_000).items()}
    assert {r.id: r.cluster for r in got.collect()}[4] == 1


def test_links_join_what_pairs_join(spark):
    """Dense cells, boxes in doubt, and gaps just at the radius."""
    rng = random.Random(6)
    for scale in (3.0, 12.0):
        points = [(0, k, rng.uniform(0, scale), rng.uniform(0, scale)) for k in range(120)] + [(0, 200, 0.0, -1.0), (0, 201, -1.0, 0.0), (0, 202, -2.0, 0.0)]
        staging = Staging(spark)
        df = spark.createDataFrame(points, "page int, node long, x double, y double")
        got = {r.node: r.label for r in clusters.connected(clusters.close_links(df, "page", 1.0, staging), staging).collect()}
        root = {p[1]: p[1] for p in points}
        for _ in points:
            for _, a, x, y in points:
                for _, b, u, v in points:
                    if (x - u) * (x - u) + (y - v) * (y - v) < 1.0:
                        root[a] = root[b] = min(root[a], root[b])
        assert {p[1]: got.get(p[1], p[1]) for p in points} == root


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_connected_paths_and_stars(spark, n):
    staging = Staging(spark)
    edges = [(k, k + 1) for k in range(n)] + [(1000 + k, 1000 + n) for k in range(n)] + [(7777, 7777)]
    got = {r.node: r.label for r in clusters.connected(spark.createDataFrame(edges, "a long, b long"), staging).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, **{1000 + k: 1000 for k in range(n + 1)}}
    assert math.isfinite(len(got))
