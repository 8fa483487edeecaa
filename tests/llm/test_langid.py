import random
from zlib import crc32

import numpy as np

from tallymill.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, names string"
FORMS = {"aa": ["kala", "mika", "taru", "ünda"], "bb": ["strogh", "wint", "dreck", "plonz"], "cc": ["ojo", "ñeque", "lluvia", "zaga"]}


def rows_of(rng, n):
    return [(k, " ".join("".join(rng.choices(FORMS[lang], k=rng.randint(1, 2))) for _ in range(rng.randint(1, 40))), lang, 1.0, "x") for k, lang in ((k, rng.choice(sorted(FORMS))) for k in range(n))]


def plain_subwords(text):
    """Runs of 1 to 4 characters inside words, borders included, by their text."""
    t = f" {text.lower()} "
    t = "".join(c if c.isalpha() else " " for c in t)
    out = []
    for n in range(1, langid.ORDER + 1):
        for i in range(len(t) - n + 1):
            run = t[i : i + n]
            if run.strip() and " " not in run[1:-1]:
                out.append(run)
    return out


def test_subwords_are_all_runs_of_words():
    for text in ("Grüß Gott, a1b", "x", "  ", "日本語 ok", "a" * 50):
        by_bucket = {}
        for run in plain_subwords(text):
            by_bucket[run] = by_bucket.get(run, 0) + 1
        got = np.concatenate([b for _, b in langid.subwords([text])]) if text.strip() else np.zeros(0)
        assert len(got) == sum(by_bucket.values())
        assert sorted(np.unique(got, return_counts=True)[1]) == sorted(by_bucket.values())


def test_slices_do_not_matter():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(FORMS["bb"] + FORMS["cc"], k=rng.randint(0, 300))) for _ in range(20)] + [None, "", "12 34"]

    def counted(size):
        out = {}
        for row, bucket in langid.subwords(texts, size):
            for r, b in zip(row.tolist(), bucket.tolist()):
                out[r, b] = out.get((r, b), 0) + 1
        return out

    whole = counted(1 << 19)
    assert counted(64) == whole and counted(1000) == whole
    alone = {(i, b): n for i, t in enumerate(texts) for b, n in zip(*map(np.ndarray.tolist, langid.bags([t])[0]))}
    assert alone == whole


def test_held_out_accuracy_and_calibration(spark):
    rows = rows_of(random.Random(5), 900)
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df)
    got = langid.identify(df, model).collect()
    want = {k: lang for k, _, lang, *_ in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in want if crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.8 * len(held) and np.mean([r.lang_pred == want[r.doc_id] for r in sure]) >= 0.98
    again = langid.train(df.repartition(7))
    assert np.array_equal(again.table, model.table)  # the sample and the order of learning do not depend on partitions


def test_texts_of_no_known_language_are_rejected(spark):
    model = langid.train(spark.createDataFrame(rows_of(random.Random(5), 600), SCHEMA))
    best, score = model.predict(["q", "ж й щ", "kala mika taru taru mika"])
    assert score[0] < score[2] and score[1] < score[2] and score[2] >= model.least


def test_odd_rows(spark):
    rows = rows_of(random.Random(6), 300)
    rows += [(1000, None, "aa", 1.0, "x"), (1001, "", "bb", 1.0, "x"), (1002, "123 !?", "bb", 1.0, None), (None, "kala mika", "aa", 1.0, "x"), (1003, "kala " * 300_000, None, 1.0, "x"), (1003, "kala " * 300_000, None, 1.0, "x"), (1004, "strogh wint", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(df, langid.train(df))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [(by[k][0].lang_pred, by[k][0].score, by[k][0].accepted) for k in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert by[None][0].held_out and by[None][0].lang_pred == "aa"
    assert [r.lang_pred for r in by[1003]] == ["aa", "aa"] and by[1004][0].lang_pred == "bb"


def test_rows_of_one_id_do_not_swell_the_sample(spark):
    rows = rows_of(random.Random(7), 60) + [(3, "kala mika", "aa", 1.0, "x")] * 500
    df = spark.createDataFrame(rows, SCHEMA)
    one = langid.train(df, sample=10)
    assert np.array_equal(one.table, langid.train(df.distinct(), sample=10).table)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert langid.identify(df, langid.train(df)).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc", "x", 1.0, "")], SCHEMA), langid.LanguageModel([])).first().lang_pred == "und"
