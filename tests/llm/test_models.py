"""Classifiers: exactness of inference, held-out accuracy, edges."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import labelled, quality, toxicity

FOLDER = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    chain = toxicity.Chain()
    rng = np.random.default_rng(1)
    chain.trans, chain.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    for n in (1, 2, 5):
        e = rng.normal(size=n) * 2
        total = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(chain.start[path[0]] + sum(chain.trans[a, b] for a, b in zip(path, path[1:])) + sum(e[k] for k in range(n) if path[k]))
            for k, s in enumerate(path):
                total[k, s] += w
        assert np.allclose(chain.marginals([e])[0], total[:, 1] / total.sum(axis=1))


def test_chunks_do_not_change_marginals(monkeypatch):
    chain = toxicity.Chain()
    rng = np.random.default_rng(2)
    chain.trans, chain.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    docs = [rng.normal(size=n) for n in (0, 1, 300, 7, 1000)]
    whole = chain.marginals(docs)
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    cut = chain.marginals(docs)
    assert [len(m) for m in cut] == [0, 1, 300, 7, 1000]
    assert all(np.allclose(a, b) for a, b in zip(whole, cut))


def test_lookup_tables_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.Gam(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def held(spark, scored, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return scored.where("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    out = held(spark, quality.score_quality(docs, quality.train(docs, labels)), "quality")
    assert len(out) > 400 and (out.predicted == out.quality).mean() > 0.98


def test_quality_scores_equal_plain_sums(spark):
    """Each row's score is the logistic of the base and one table entry a feature and pair, looked up by plain bisection."""
    from bisect import bisect_right
    from math import exp

    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "x", "y", 0)], docs.schema))
    model = quality.train(docs, labels)

    def plain(text):
        x = quality.features(None if text is None else text.encode())
        total = model.base + sum(float(t[bisect_right(list(c), v)]) for t, c, v in zip(model.tables, model.cuts, x))
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += float(table[bisect_right(list(model.coarse[i]), x[i]), bisect_right(list(model.coarse[j]), x[j])])
        return 1 / (1 + exp(-total))

    want = sorted(((r.doc_id, round(plain(r.text), 9)) for r in docs.collect()), key=str)
    got = quality.score_quality(docs, model).collect()
    assert sorted(((r.doc_id, round(r.score, 9)) for r in got), key=str) == want
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    kept = sorted((r.doc_id for r in quality.keep_good(docs, model).collect()), key=str)
    assert kept == sorted((r.doc_id for r in got if r.predicted), key=str)


def test_toxicity_scores_equal_rows_alone(spark):
    """A row's score does not depend on the rows beside it, on its partition or on its other columns."""
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    whole = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    alone = toxicity.score_toxicity(docs.withColumn("score", F.lit(1)).withColumn("spans", F.lit("x")).repartition(23), model)
    assert {r.doc_id: r.score for r in alone.collect()} == pytest.approx(whole, abs=1e-9)
    assert all(0 <= s <= 1 for s in whole.values())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    out = held(spark, scored, "toxic")
    assert (out.predicted == out.toxic).mean() > 0.97 and out.predicted[out.toxic == 1].mean() > 0.9
    row = scored.where(F.size("spans") > 0).join(docs, "doc_id").select(F.expr("substring(text, cast(spans[0].start as int) + 1, cast(spans[0].end - spans[0].start as int))").alias("w")).first()
    assert row.w.strip() == row.w and " " not in row.w


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_edges(spark, which):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None), (3, "", ""), (3, "", ""), (None, "x y z", ""), (4, "w " * 40000, "")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (None, 1, 1), (4, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        if which == "quality":
            run = lambda d: quality.score_quality(d, quality.train(docs, labels))  # noqa: B023,E731
        else:
            run = lambda d: toxicity.score_toxicity(d, toxicity.train(docs, labels))  # noqa: B023,E731
        rows = run(docs).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [True]
        assert run(docs.limit(0)).count() == 0
    if which == "quality":
        assert quality.keep_good(docs, quality.train(docs, some)).columns == docs.columns


def test_held_out_rule(spark):
    from zlib import crc32

    ids = spark.createDataFrame([(k,) for k in range(-5, 200)], "doc_id long")
    assert all(r.h == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids.select("doc_id", labelled.held_out("doc_id").alias("h")).collect())
