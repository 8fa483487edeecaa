"""Target-distribution importance resampling: documents drawn as if from a target.

Features are the runs of 1 to 2 consecutive words. Their hashed counts over the
corpus and over a target give each of ``BUCKETS`` buckets a gain, a document's
weight is the mean gain of its features, and a Gumbel draw without replacement
(seeded by the id's hash) takes ``SHARE`` in a hundred of the documents of at least
``LEAST_WORDS`` words.

*Hashing.* Words are mapped to the integers of a dictionary, and a run is a tuple of
such integers, packed into 64 bits; each distinct tuple's bytes are put together and
hashed once, and the buckets are joined back to the occurrences by the tuples. The
dictionary is that of a few thousand documents of a task (``common.slices``): integers never leave their task, so no
occurrence is shuffled, as a dictionary of the whole corpus would ask for. Each
document's buckets (two bytes an occurrence) are written to the shared folder, so
texts are read and hashed once.

*Draw.* Scores are whole numbers within some tens of thousands whatever the corpus
holds (the logarithms of 64-bit counts and of 32-bit hashes bound them). A histogram
of scores, of at most that many rows, says how many rank before each score; ranks
are then numbered within a score.

Defined results: a null or empty text has no features, weight 0 and is never drawn;
a null id hashes as an empty one and goes last among equal scores; rows that
repeat are documents of their own and ranked one after the other; an empty target has
T = 0; empty tables give no rows; further columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import LOWER, discard, materialize, pieces, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 7, 25, 20


class Dictionary(dict):
    """Numbers words as they first appear."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def hashed_runs(texts: list[str | None], buckets: int = BUCKETS) -> list[np.ndarray]:
    """The buckets of all runs of 1 and 2 words of each text, single words first."""
    words = Dictionary()
    sizes, ids = [], []
    for text in texts:
        n = 0
        for piece in pieces(text or "", WORD):
            found = WORD.findall(piece.translate(LOWER))
            ids.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
            n += len(found)
        sizes.append(n)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    single = np.fromiter((crc32(w) % buckets for w in raw), np.uint16, len(raw))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    # tuples of neighbours, those across the end of a text included and not used
    tuples, at = np.unique(flat[:-1] * len(raw) + flat[1:], return_inverse=True)
    first = [crc32(b" ", crc32(w)) for w in raw]
    double = np.fromiter((crc32(raw[b], first[a]) % buckets for a, b in zip((tuples // max(1, len(raw))).tolist(), (tuples % max(1, len(raw))).tolist())), np.uint16, len(tuples))
    one, two = single[flat], double[at]
    return [np.concatenate((one[e - n : e], two[e - n : max(e - n, e - 1)])) for n, e in zip(sizes, ends)]


def features(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(id, n_words, runs)``: the buckets of each row, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            runs = hashed_runs(batch.column(1).to_pylist(), buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(len(r) + 1) // 2 for r in runs], pa.int64()), pa.array([r.tobytes() for r in runs], pa.binary())], names=["id", "n_words", "runs"])

    ids = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(ids.alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, runs binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of the buckets that occur; a task hands on one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n += np.bincount(np.frombuffer(raw, np.uint16), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    return rows.select("runs").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: ``buckets`` numbers, whatever the corpus holds."""
    spark = corpus.sparkSession
    both = spark.range(buckets).select(F.col("id").alias("bucket")).join(bucket_counts(corpus, buckets).withColumnRenamed("n", "s"), "bucket", "left")
    both = both.join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "left").na.fill(0).collect()
    all_s, all_t = sum(r.s for r in both), sum(r.t for r in both)
    odds = spark.createDataFrame([(r.bucket, float((r.t + 1.0) * (all_s + float(buckets)) / ((r.s + 1.0) * (all_t + float(buckets))))) for r in both], "bucket long, odds double")
    out = np.zeros(buckets, np.int64)
    for r in odds.select("bucket", F.floor(1000 * F.ln("odds")).alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weighed(rows: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [], []
            for raw in batch.column(2).to_pylist():
                r = np.frombuffer(raw, np.uint16)
                sizes.append(len(r))
                sums.append(int(gain[r].sum()) // len(r) if len(r) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` with ``rank``, null where not drawn."""
    fit = rows.where(F.col("n_words") >= least_words)
    whole = Window.orderBy(F.desc("score"))
    hist = fit.groupBy("score").agg(F.count("*").alias("n_"))
    hist = hist.withColumn("before_", F.coalesce(F.sum("n_").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hist = hist.withColumn("most_", F.floor(F.sum("n_").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share / 100))
    ahead = rows.withColumn("fit_", F.when(F.col("n_words") >= least_words, F.col("score"))).join(F.broadcast(hist.where("before_ < most_").withColumnRenamed("score", "fit_")), "fit_", "left")
    out = [*rows.columns, "rank"]
    place = F.row_number().over(Window.partitionBy("fit_").orderBy(F.col("id").asc_nulls_last())) + F.col("before_")
    ranked = ahead.where("before_ is not null").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("most_"), F.col("rank")))
    return ranked.select(*out).unionByName(ahead.where("before_ is null").withColumn("rank", F.lit(None).cast("long")).select(*out))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``."""
    spark = docs.sparkSession
    rows = materialize(features(docs, id_col, text_col), "runs")
    gain = gains(rows, features(target, None, target_text))
    scored = materialize(weighed(rows, gain, seed), "weights")
    discard(spark, rows.scratch)
    out = drawn(scored, share, least_words)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
