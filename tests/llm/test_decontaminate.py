import random
import re
from hashlib import sha256

from tallymill.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, bench, window):
    w = plain_words(text)
    hit, items = set(), set()
    for item, t in bench:
        b = plain_words(t)
        size = min(window, len(b))
        for p in range(len(b) - size + 1) if size else ():
            for q in range(len(w) - size + 1):
                if w[q : q + size] == b[p : p + size]:
                    hit |= set(range(q, q + size))
                    items |= {str(item)} - {"None"}
    return len(w), len(hit), len(items), sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def cases(seed, n):
    rng = random.Random(seed)
    vocab = ["a", "B", "é", "x1", "the", "ß", "oo"]
    bench = [(k, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 5, 9, 14])))) for k in range(8)] + [(8, None), (None, "b é é"), (3, "the the the"), (9, "the the the")]
    docs = [(k, ", ".join(rng.choices(vocab + ["zz"], k=rng.randint(0, 60)))) for k in range(n)] + [(900, None), (901, ""), (5, "The the THE")]
    return docs, bench


def test_equals_brute_force(spark):
    for seed, window, block, shard in ((1, 4, 8 << 20, 1 << 20), (2, 5, 20, 50), (3, 10, 8 << 20, 100)):
        docs, bench = cases(seed, 60)
        df = spark.createDataFrame([(a, b, None) for a, b in docs], "doc_id long, text string, items string")
        bf = spark.createDataFrame(bench, "item_id long, text string")
        got = dc.contamination(df, bf, window=window, block_bytes=block, shard=shard).collect()
        want = sorted(((d, *brute(t, bench, window)) for d, t in docs), key=str)
        assert sorted((tuple(r)[:6] for r in got), key=str) == want
        for r in got:
            assert sum(h.end - h.first for h in r.hits) == r.n_hit and (r.longest_match > 0) == r.contaminated
        kept = dc.remove_contaminated(df, bf, window=window, block_bytes=block, shard=shard)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, *_, bad in want if not bad)


def test_long_items_and_longest_match():
    words = [f"w{k}" for k in range(200)]
    tests = dc.Tests([("7", " ".join(words).encode())])
    text = " ".join(["x"] * 5 + words[20:75] + ["y"] + words[100:111]).encode()
    (row,) = dc._rows(tests, [text], 1 << 20)
    assert row == (5 + 55 + 1 + 11, [(5, 60), (61, 72)], {"7"}, 55)


def test_longest_match_is_of_one_item(spark):
    """Two items that overlap do not make one match; places are those of the item."""
    words = [f"w{k}" for k in range(12)]
    bench = [("a", " ".join(words[:11])), ("b", " ".join(words[1:]))]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:11])), (3, " ".join(words * 3))], "doc_id long, text string")
    for block in (8 << 20, 30):
        got = {r.doc_id: (r.longest_match, r.n_hit, r.n_items) for r in dc.contamination(docs, spark.createDataFrame(bench, "item_id string, text string"), block_bytes=block).collect()}
        assert got == {1: (11, 12, 2), 2: (11, 11, 2), 3: (11, 36, 2)}


def test_longest_match_equals_brute_force():
    rng = random.Random(11)
    for _ in range(40):
        items = [[rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(4)]
        doc = [rng.choice("abcz") for _ in range(80)]
        tests = dc.Tests([(str(k), " ".join(w).encode()) for k, w in enumerate(items)], 4)
        (row,) = dc._rows(tests, [" ".join(doc).encode()], 1 << 20)
        best = 0
        for w in items:
            for p in range(len(w)):
                for q in range(len(doc)):
                    n = 0
                    while p + n < len(w) and q + n < len(doc) and w[p + n] == doc[q + n]:
                        n += 1
                    best = max(best, n if n >= min(4, len(w)) else 0)
        assert row[3] == best


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    (row,) = dc.contamination(docs, bench).collect()
    assert (row.n_words, row.n_hit, row.contaminated, row.items_sha256) == (2, 0, False, sha256(b"").hexdigest())
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_rows_are_removed_in_small_parts(spark, monkeypatch):
    """What a task sorts at once follows the slice of texts, not the batch of rows."""
    import pyarrow as pa

    seen, real = [], dc._rows
    monkeypatch.setattr(dc, "_rows", lambda tests, texts, shard: seen.append(sum(map(len, texts))) or real(tests, texts, shard))
    passage = "one two three four five six seven eight nine ten"
    texts = [f"{k} " * 4000 + (passage if k % 7 == 0 else "") for k in range(600)]
    monkeypatch.setattr(type(spark.createDataFrame([(1,)], "a int")), "mapInArrow", lambda df, run, schema: list(run(iter([pa.RecordBatch.from_pylist(df.toPandas().to_dict("records"))]))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    kept = [i for batch in dc.remove_contaminated(docs, bench) for i in batch.column(0).to_pylist()]
    assert kept == [k for k in range(600) if k % 7] and max(seen) <= dc.SLICE + max(map(len, texts)) < sum(map(len, texts)) / 4
