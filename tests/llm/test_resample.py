import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

from tallymill.llm import resample

SCHEMA = "doc_id long, text string, id long, rank string, score int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(rows, target):
    docs = [(d, *plain_features(t)) for d, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for d, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: 25 * len(fit) // 100]
    return sorted([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in fit[len(drawn) :] + [r for r in out if r[4] < 20]], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA)


def test_equals_brute_force(spark):
    rng = random.Random(9)
    words = [a + b for a in "abcÉñ1" for b in "XyZ7"]
    rows = [(k, rng.choice([" ", ", "]).join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(200)]
    rows += [(300, None), (301, ""), (302, "..."), (303, "one"), (None, "ay " * 30), (None, "ay " * 30), (304, "ay bx " * 20), (304, "ay bx " * 20), (305, "word " * 50_000)]
    target = ["ax cy " * 9, None, "", "bz"]
    goal = spark.createDataFrame([(str(k), t, 1) for k, t in enumerate(target)], "item_id string, text string, doc_id int")
    got = sorted((tuple(r) for r in resample.resample(frame(spark, rows).repartition(6), goal).collect()), key=str)
    assert got == brute(rows, target)


def test_pieces_and_batches_do_not_matter(monkeypatch):
    texts = ["a b c a b " * 40, None, "x", "é" * 90 + " b", ""]
    whole = [r.tolist() for r in resample.hashed_runs(texts)]
    assert whole == [r.tolist() for t in texts for r in resample.hashed_runs([t])]
    assert whole == [plain_features(t)[1] for t in texts]
    cut = resample.pieces
    monkeypatch.setattr(resample, "pieces", lambda text, word: cut(text, word, 5))
    assert whole == [r.tolist() for r in resample.hashed_runs(texts)]


def test_draw_prefers_the_target(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["sun", "sea", "sand"] if k % 2 else ["tax", "law", "court"], k=30))) for k in range(400)]
    goal = spark.createDataFrame([("a", "sun sea sand sea sun " * 4000)], "item_id string, text string")
    picked = [r.doc_id for r in resample.resample(frame(spark, rows), goal).where("rank is not null").collect()]
    assert len(picked) == 100 and sum(k % 2 for k in picked) >= 90


def test_empty_tables(spark):
    goal = spark.createDataFrame([], "item_id string, text string")
    assert resample.resample(frame(spark, []), goal).count() == 0
    got = resample.resample(frame(spark, [(1, "a " * 30), (2, "b")]), goal).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 59, None), (2, 1, None)]
