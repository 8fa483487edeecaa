"""Links of a page from its points, beside the same choice from all pairs."""

import random
from math import hypot

from tallymill.operators import linking, matching


def from_pairs(markers, glyphs, radius):
    """All pairs in order of ``(distance, marker, glyph)``, one after the other."""
    pairs = sorted((hypot(m[1] - g[1], m[2] - g[2]), m[0], g[0], g[4:]) for m in markers for g in glyphs if m[3] == g[3] and hypot(m[1] - g[1], m[2] - g[2]) <= radius)
    held, used, taken, ordinals = {}, set(), {}, set()

    def greedy(whole_only):
        for pair in pairs:
            _, marker, glyph, (ordinal, word, start, end, whole) = pair
            if marker in held or glyph in used or not whole and (whole_only or ordinal in ordinals):
                continue
            if any(start < e and s < end for s, e in taken.get(word, ())):
                continue
            held[marker] = pair
            used.add(glyph)
            taken.setdefault(word, []).append((start, end))
            ordinals.add(ordinal)

    greedy(True)
    seen = set()
    for _, marker, glyph, (ordinal, word, start, end, _) in sorted(held.values()):
        if ordinal in seen:
            del held[marker]
            used.discard(glyph)
            taken[word].remove((start, end))
        seen.add(ordinal)
    greedy(False)
    numbers = [p[3][0] for p in held.values()]
    return {(m, p[2]) for m, p in held.items() if numbers.count(p[3][0]) == 1}


def test_choice_equals_that_of_all_pairs():
    """With copies of places, merged words that overlap, ordinals that repeat and glyphs of both outcomes."""
    rng = random.Random(9)
    for trial in range(150):
        at = lambda: (rng.choice((0.0, 1.0, rng.uniform(0, 9))), rng.choice((0.0, rng.uniform(0, 9 if trial % 2 else 3))))
        markers = [(k, *at(), rng.choice("ab")) for k in rng.sample(range(500), rng.randint(0, 40))]
        glyphs = []
        for k in rng.sample(range(500), rng.randint(0, 40)):
            start = rng.randrange(3)
            place, row = at(), (rng.randrange(25), rng.randrange(15), start, start + rng.randint(1, 2), rng.random() < 0.5)
            glyphs += [(k, *place, outcome, *row) for outcome in rng.choice(("a", "b", "ab"))]
        got = {(markers[m][0], glyphs[g][0]) for m, g in linking.choose(markers, glyphs, 2.5)}
        assert got == from_pairs(markers, glyphs, 2.5), trial


def test_crowded_page_is_no_table_of_pairs(spark):
    """3,000 markers and as many glyphs at one place are nine million pairs; points alone reach the task."""
    from pyspark.sql import functions as F

    n = spark.range(3000).select(F.lit(1).alias("page"), "id")
    markers = n.select("page", F.col("id").alias("marker"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit("a").alias("outcome"))
    glyphs = n.select("page", F.col("id").alias("glyph"), F.lit(1.0).alias("bx"), F.lit(0.0).alias("by_"), F.col("id").alias("ordinal"), F.col("id").alias("word"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(True).alias("whole"))
    rows = n.select("page", F.col("id").alias("ordinal"), F.array(F.lit("a")).alias("outcomes"))
    out = matching.linked(markers, glyphs, rows, ["page"], 5.625)
    assert "cx_" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == 3000 and all(r.ordinal == r.marker and r.distance == 1.0 for r in got)
