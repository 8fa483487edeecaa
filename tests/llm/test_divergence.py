import random
import re
from collections import Counter

from tallymill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, top=200, least=3):
    docs = [(x or "", s or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t, x, s, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        held = Counter(w for _, _, ws in of for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= least)

        def p(some):
            n = Counter(w for _, _, ws in some for w in ws)
            total = sum(n[w] for w in kept)
            return n, {w: 1 + 10**9 * (n[w] + 1) // (total + len(kept)) for w in kept}

        whole = p(of)[1]
        groups = {s: p([d for d in of if d[1] == s]) for s in {d[1] for d in of}}
        f = lambda a, b: (a - b) ** 2 // b
        for s, (n, mine) in groups.items():
            pairs = [(-sum(f(mine[w], other[w]) for w in kept), o.encode(), o) for o, (_, other) in groups.items() if o != s]
            terms = [(-f(mine[w], whole[w]), w.encode(), w) for w in kept if n[w] and mine[w] > whole[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


def rows_of(rng, n):
    words = [a + b for a in "abcdé" for b in "xyzñ"] + ["The", "THE", "ß"]
    return [(k, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None, "z"]), "extra", 1) for k in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = rows_of(rng, 120) + [(1, None, "en", "silent", "x", 1), (None, "ax ay", "lone", "a", None, None), (None, "ax ay", "lone", "b", None, None), (7, "bx " * 4000, "en", "s1", "x", 1), (7, "bx " * 4000, "en", "s1", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert {tuple(r) for r in divergence.audit(df).collect()} == want
    assert {tuple(r) for r in divergence.audit(df, top=3).collect()} == brute(rows, top=3)
    monkeypatch.setattr(divergence, "SMALL", 0)  # all joins shuffled, small slices, counts handed on often
    monkeypatch.setattr(divergence, "CELLS", 7)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert {tuple(r) for r in divergence.audit(df).collect()} == want


def test_best_first_reads_few_buckets(spark):
    """Bounds keep the terms of top f and leave most buckets out."""
    rng = random.Random(2)
    rows = [(k, " ".join([f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300) for _ in range(rng.randint(0, 2) + (j if k % 4 == 0 else 0) // 40)]), "en", f"s{k % 4}", "", 1) for k in range(12)]
    a = divergence.Audit(spark.createDataFrame(rows, SCHEMA))
    got = {(r.source, r.item, r.value) for r in a.term_rows(top=5).collect()}
    assert got == {(s, i, v) for _, s, part, i, v, _ in brute(rows, top=5) if part == "term"}


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_kept_terms(spark):
    got = divergence.audit(spark.createDataFrame([(1, "a b", "en", "s", "", 1), (2, None, None, "t", "", 1), (3, "", "en", "r", "", 1)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "r", "pair", "s", 0, 1), ("en", "s", "pair", "r", 0, 1)]
