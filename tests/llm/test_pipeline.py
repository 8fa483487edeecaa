"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline
from tallymill.llm.queries import tokenizer_file


def build(spark, folder):
    rng = random.Random(9)
    words = [a + b for a in "ba ke li mo nu ra si to vu ze".split() for b in "n r s t l".split()]
    prose = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    good = [(k, "\n".join(prose(40) for _ in range(4))) for k in range(300)]
    junk = [(1000 + k, "BUY!! NOW!! " * 60) for k in range(150)]
    passage = prose(30)
    planted = [(2000, good[0][1]), (2001, good[1][1] + " extra"), (2002, prose(50) + "\n" + passage + "\n" + prose(50)), (2003, None), (2004, ""), (2005, "x " * 20000)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in good + junk + planted]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return good, junk


def test_stages(spark, tmp_path):
    good, junk = build(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r.doc_id for r in docs.collect()})
    quality, lines, near, clean = seen
    assert {i for i, _ in good} <= quality and not quality & {i for i, _ in junk}
    assert lines == quality
    # the copy lost all its lines, so it is one of the empty documents, of which one stays
    assert 0 in near and len({2000, 2003, 2004} & near) == 1
    assert 2002 in near and 2002 not in clean and {i for i, _ in good} <= clean
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == clean

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out[:50]:
        assert list(r.ids) == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, line string, probe int"


def test_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, empty texts and columns of clashing names go through every stage."""
    good, _ = build(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 2000")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "f", "l", 2) for r in docs.collect()]
    fresh = "\n".join(f"Senses of number {k} run on and on in their own words and never meet again." for k in range(3))
    rows += [rows[0], (None, fresh, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (4000, "", None, None, None, None, None, None, None)]
    stage_docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, str(tmp_path))
        assert stage_docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes, name
        stage_docs = spark.createDataFrame(stage_docs.collect(), SCHEMA)
    ids = [r.doc_id for r in stage_docs.collect()]
    assert {i for i, _ in good} <= set(ids) and ids.count(good[0][0]) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, stage_docs, str(tmp_path)).count() == len(ids)


def test_empty_tables(spark, tmp_path):
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_arrow_batches_small(spark, tmp_path):
    """Stages with Python workers bound the rows that are held at once, and leave a smaller bound as it is."""
    key = corpus_pipeline._BATCH
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    try:
        for found, wanted in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("7", 7)):
            for name, stage in corpus_pipeline.STAGES[3:]:
                spark.conf.set(key, found)
                stage(spark, docs, str(tmp_path))
                assert int(spark.conf.get(key)) == wanted, name
    finally:
        spark.conf.set(key, before)
