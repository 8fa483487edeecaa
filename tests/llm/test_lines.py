import random

from tallymill.llm import lines


def shingles(line, k=lines.SHINGLE):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def brute(rows):
    """Texts after dedup of ``(id, text)``; rows that repeat are one document."""
    places = {}
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for d, (i, t) in enumerate(docs):
        for p, line in enumerate(t.split("\n") if t is not None else ()):
            if line.strip(" \t\r\x0b\x0c"):
                places.setdefault(line, []).append((i is None, i or 0, d, p))
    names = list(places)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {n: shingles(n) for n in names}
    for a in range(len(names)):
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if len(x & y) >= 0.8 * len(x | y):
                root[find(names[a])] = find(names[b])
    first = {}
    for n in names:
        first[find(n)] = min([first.get(find(n), (2,)), *places[n]])
    gone = {p[2:] for n in names for p in places[n] if p != first[find(n)]}
    cut = {(i, t): t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, (i, t) in enumerate(docs)}
    return [(i, cut[i, t]) for i, t in rows]


def test_equals_brute_force(spark):
    rng = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda é ñu 😀 👩‍🚀ab".split()
    base = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(40)]

    def vary(s):
        w = s.split(" ")
        if len(w) > 30 and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "x"  # far above the threshold: banding finds it for certain enough
        return " ".join(w)

    rows = [(k, "\n".join(vary(rng.choice(base)) if rng.random() < 0.7 else "" for _ in range(rng.randint(0, 6)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (3, rows[3][1]), (None, base[0] + "\nonly here é"), (103, "short"), (104, "short"), (105, "z" * 20000), (106, "z" * 20000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, line string, n_lines int")
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    near = [(g, w) for g, w in zip(got, want) if g != w]
    assert not near, near[:3]


def test_counts_and_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "one line here\nsecond"), (2, "one line here")], "doc_id long, text string")
    out = lines.dedup_lines(df, counts=True)
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    assert rows == {1: (2, 0, "one line here\nsecond"), 2: (1, 1, "")}
    assert "Python" not in out._jdf.queryExecution().toString()


def test_crowd_of_near_copies(spark):
    """Lines of one crowded bucket, most of them just below the threshold to each other:
    components equal those of all pairs, and the bucket's pairs are not put out."""
    rng = random.Random(3)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(45)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 4])):
            w[rng.randrange(45)] = f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute(rows))


def test_sketch_bound_holds(spark):
    """The odd sketch never rules out a pair that reaches the threshold."""
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        t = "".join(rng.choices("abc 😀", k=rng.randint(3, 400)))
        cut = rng.randint(0, len(t) // 12)
        texts += [t, t[cut:]]
    rows = [(k, k, k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "node long, h1 long, h2 long, line string")
    made = lines._texts(df, df.select("node", "h1", "h2"), lines.SHINGLE)
    pairs = spark.createDataFrame([(b, a) for b in range(len(texts)) for a in range(b)], "a long, b long")
    got = {(r.a, r.b) for r in lines.verified(pairs, made, 0.8, lines.SHINGLE).collect()}
    sets = [shingles(t) for t in texts]
    assert got == {(b, a) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {r.node: r.n for r in made.select("node", "n").collect()} == {k: len(s) for k, s in enumerate(sets)}


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_find_pairs_at_the_threshold():
    """Recall of bands and marks for sets of similarity 0.8 and 0.9, with the masks as they are."""
    import numpy as np

    masks = np.array([m & (1 << 64) - 1 for m in lines._MASKS], np.uint64)
    draw = np.random.default_rng(5)
    for similarity, least in ((0.8, 0.95), (0.9, 0.99)):
        found, n = 0, 200
        common = round(2 * n * similarity / (1 + similarity))
        for _ in range(800):
            h = draw.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64)
            equal = (h[:n, None] ^ masks).min(axis=0) == (h[n - common :, None] ^ masks).min(axis=0)
            found += equal.reshape(lines.BANDS, lines.ROWS).all(axis=1).any() and equal.sum() >= lines.AGREE
        assert found / 800 >= least


def test_crowd_puts_out_few_pairs(spark, monkeypatch):
    """Near copies of one line, most of them similar to each other: candidates grow with the lines and not with their square."""
    rng = random.Random(12)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(45)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(45)] = f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}"
        rows.append((k, " ".join(w)))
    pairs, real = [], lines.materialize

    def counted(df, tag):
        out = real(df, tag)
        if tag == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute(rows)) and sum(pairs) < 20 * len(rows)
