import itertools
import random

import corpus_pipeline
from tallymill.llm import near, simhash


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def planted(seed=4, groups=60):
    """Texts of 40 to 400 words with copies of which up to a fiftieth of the words is changed."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 400))]
        rows.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 50))):
                copy[k] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def kept_by_brute_force(rows):
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        near_bits = bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1") <= simhash.RADIUS
        if near_bits or similarity(a, b) >= near.SIMILARITY:
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    return {find(k) for k, _ in rows}


def test_stage_drops_similar_documents(spark):
    rows = planted()
    got = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == kept_by_brute_force(rows)


def test_recall_at_the_threshold():
    """Bands of texts whose similarity is from 0.8 to 0.83."""
    rng, met, seen = random.Random(6), 0, 0
    while seen < 200:
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = list(base)
        for k in rng.sample(range(300), 6):
            copy[k] = "x" + copy[k]
        a, b = " ".join(base), " ".join(copy)
        if not 0.8 <= similarity(a, b) <= 0.83:
            continue
        seen += 1
        met += bool(set(near.bands(near.shingles(a.encode()))) & set(near.bands(near.shingles(b.encode()))))
    assert met >= 196


def test_nulls_and_repeats(spark):
    rows = [(5, "a b c d"), (3, "A b\nc d"), (3, "A b\nc d"), (7, None), (8, ""), (None, "a b c d"), (None, "only null"), (None, "only null")]
    out = near.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == [-1, 3, 7]
    assert near.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
