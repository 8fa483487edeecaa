import itertools
import random

import xxhash

from tallymill.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node long"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", best.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = "the of and Éa ñ to x in be on".split(" ")
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\t\n"), (203, "A  b\nC d"), (204, "a b c D"), (204, "a b c D"), (None, "zz yy xx ww"), (None, "a b c d"), (9000, "w " * 5000)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    for tile in (512, 2):
        got = sorted((tuple(r) for r in simhash.simhash_components(df, tile=tile).collect()), key=str)
        assert got == brute(rows)


def test_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {frozenset(p) for p in itertools.combinations(signed, 2) if bin((p[0] ^ p[1]) & (2**64 - 1)).count("1") <= 2}

    def classes(pairs):
        root = {f: f for f in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(g) for g in _groups(find, signed)}

    def _groups(find, items):
        out = {}
        for i in items:
            out.setdefault(find(i), set()).add(i)
        return out.values()

    for tile in (512, 4):
        got = {frozenset((r.a, r.b)) for r in simhash.near_pairs(df, tile=tile).collect()}
        assert classes(map(tuple, got)) == classes(map(tuple, want))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


def test_drop_keeps_one_of_each(spark):
    rows = [(5, "a b c d", "x", 1), (3, "a b c d", "y", 2), (3, "a b c d", "y", 2), (7, "q w e r t", None, None), (None, "a b c d", "z", 3), (None, "only null", "z", 3), (None, "only null", "z", 4), (None, "x1 y2 z3 w4 v5", "z", 5)]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "fp", "node"]
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, -1, 3, 7]
