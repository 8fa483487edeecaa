"""A training corpus from ``documents``: each stage works on all its predecessor kept.

Stages but the last return the columns of ``documents``; the last returns the
token ids. ``run`` writes each stage's rows to the shared folder and reads them
again, so a lost executor repeats one stage's tasks at most.

Defined results: null and empty texts are documents like any other (the classifier
judges them, those left are copies of each other); rows of null ids stay where
their stage keeps them; rows that repeat id and text are judged alike, and one of them
stays after near-dedup; an empty table gives an empty result; further columns pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import bpe, decontaminate, lines, near, quality
from tallymill.llm.common import discard, materialize
from tallymill.llm.queries import tokenizer_file

#: Rows of an Arrow batch at most. Executors and their Python workers hold whole batches
#: of texts, and Spark's usual 10,000 rows are a whole task here.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH_ROWS`` rows at most from now on."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _small_batches(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; all documents stay.
    Where there is an ``n_chars``, it follows the text."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: SimHash links, and Jaccard
    similarity of five-word shingles from 0.8 on."""
    _small_batches(spark)
    return near.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    _small_batches(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    _small_batches(spark)
    return bpe.encode_corpus(docs, tokenizer_file())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", encode),
]

#: The classifier's tables and the tokens are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split(' ')[0].lower()}")
        if before:
            discard(spark, before)
        before = docs.scratch
    return STAGES[-1][1](spark, docs, sf_dir)
