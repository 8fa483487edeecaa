"""Near copies of documents: Jaccard similarity of five-word shingles from ``SIMILARITY`` on.

SimHash links fingerprints that differ in few bits; most texts of similarity 0.8
are further apart. ``similar_links`` finds those by MinHash:

* A text is the set of the XXH64 hashes of its five-word shingles. Minima of one
  hash under ``BANDS * ROWS`` exclusive-or masks agree with the probability of
  the similarity; texts of similarity 0.8 meet in a band with probability 0.997.
* Texts that SimHash or an equal set has linked are one component from the
  start. ``STARS`` rounds pair one text of each component in a bucket with one of
  its largest; then texts of different components in a bucket are compared by odd
  sketches (``CELLS`` words of parities of the hashes of a set): as many bits as two
  sketches differ in, so many shingles at least are in one set alone. A pair that
  this bound rules out is none for certain, so a crowded bucket puts out only pairs
  close to the threshold or above it.
* A pair counts if the exact similarity of its sets reaches the threshold.

Defined results: as in ``simhash``; a text of fewer than five words is one
shingle, so empty and null texts are copies of each other.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm import simhash
from tallymill.llm.common import as_bytes, components, materialize

SIMILARITY = 0.8
WORDS = 5
BANDS, ROWS = 25, 7
STARS = 2
CELLS = 32
_RANDOM = random.Random(23)
_MASKS = np.array([_RANDOM.getrandbits(64) for _ in range(BANDS * ROWS)], np.uint64)
_CHUNK = 1 << 10
_ROWS = 256
_ODD = [f"s{w}" for w in range(CELLS)]


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted set of a text's shingles, as 64-bit hashes."""
    import xxhash

    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, 5)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], 5) for s, e in zip(starts[: len(words) - WORDS + 1].tolist(), ends[WORDS - 1 :].tolist())], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima."""
    import xxhash

    least = np.full(len(_MASKS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[at : at + _CHUNK, None] ^ _MASKS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """``CELLS`` words of parities of a set of hashes."""
    place = (hashes % np.uint64(CELLS) << np.uint64(6)) | (hashes >> np.uint64(8) & np.uint64(63))
    odd = np.bincount(place.astype(np.int64), minlength=64 * CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, shape, bands, hashes, n, s0, s1, ...)`` of each row, with the size of the set
    and its sketch; equal sets have an equal shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        long = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
        # sets are held for a few rows at a time: they take more than the texts
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            texts = as_bytes(batch.column(1))
            sets = [shingles(t) for t in texts]
            keys = pa.FixedSizeListArray.from_arrays(long([k for s in sets for k in bands(s)]), BANDS).cast(pa.list_(pa.int64()))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), long(np.concatenate([np.zeros(0, np.uint64), *sets])))
            odd = np.array([odd_sketch(s) for s in sets], np.uint64).reshape(len(sets), CELLS)
            columns = {
                "id": batch.column(0), "fp": long([simhash.fingerprint(t) for t in texts]), "shape": long([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]), "bands": keys, "hashes": hashes,
                "n": pa.array([len(s) for s in sets], pa.int32()), **{c: long(odd[:, w]) for w, c in enumerate(_ODD)},
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long, shape long, bands array<long>, hashes array<long>, n int, " + ", ".join(f"{c} long" for c in _ODD))


def _near(similarity: float, x: str = "x", y: str = "y") -> Column:
    """Whether the sizes and sketches of two sets allow the similarity: of sets with so much
    in common, (1 - s) / (1 + s) of both sizes at most is in one alone."""
    apart = sum((F.bit_count(F.col(c + x).bitwiseXOR(F.col(c + y))) for c in _ODD), F.lit(0))
    return apart * (1 + similarity) <= (1 - similarity) * (F.col("n" + x) + F.col("n" + y)) + 1e-6


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: the fingerprints of the pairs of shapes ``(x, y)`` that are similar."""
    left, right = (sets.select(F.col("shape").alias(s), F.col("fp").alias(f), F.col("hashes").alias(h)) for s, f, h in (("x", "a", "ha"), ("y", "b", "hb")))
    both = pairs.join(left, "x").join(right, "y")
    both = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.explode(F.array(F.size(F.array_intersect("ha", "hb")))).alias("common"))
    return both.where(F.col("common") >= similarity * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def similar_links(rows: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` between fingerprints of ``signed`` rows, with the ``known`` ones."""
    heads = rows.groupBy("shape").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    same = rows.select("shape", F.col("fp").alias("a")).distinct().join(heads.select("shape", F.col("fp").alias("b")), "shape").where("a <> b").select("a", "b")
    links = materialize(known.select("a", "b").unionByName(same), "near-links")
    keyed = heads.select("shape", "fp", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = materialize(keyed.join(shared, "key"), "near-buckets")

    def open_(links: DataFrame) -> DataFrame:
        """Members of the buckets that hold different components."""
        rooted = met.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select("key", "shape", F.coalesce("component", "fp").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return materialize(rooted.join(mixed, "key"), "near-open")

    left = open_(links)
    touched = left.select("shape").distinct()
    one = (F.first(c).alias(c) for c in ("hashes", "n", *_ODD))
    sets = materialize(rows.join(touched, "shape", "left_semi").groupBy("shape").agg(F.min("fp").alias("fp"), *one), "near-sets")
    odd = {side: sets.select(F.col("shape").alias(side), *(F.col(c).alias(c + side) for c in ("n", *_ODD))) for side in "xy"}
    tried = None
    for k in range(STARS + 1):
        if not left.limit(1).count():
            break
        if k < STARS:
            # one text of each component of a bucket meets one of the bucket's largest
            pick = F.struct(F.xxhash64("shape", F.lit(k)).alias("h"), "shape")
            reps = left.groupBy("key", "root").agg(F.count("*").alias("n"), F.min(pick)["shape"].alias("shape"))
            hubs = reps.groupBy("key").agg(F.max(F.struct("n", "shape", "root")).alias("hub"))
            pairs = reps.join(hubs, "key").where("root <> hub.root").select(F.greatest("shape", "hub.shape").alias("x"), F.least("shape", "hub.shape").alias("y")).distinct()
            pairs = pairs.join(odd["x"], "x").join(odd["y"], "y").where(_near(similarity)).select("x", "y")
        else:
            p, q = (left.select("key", F.col("shape").alias(side), F.col("root").alias("r" + side)).join(odd[side], side) for side in "xy")
            pairs = p.join(q, (p["key"] == q["key"]) & (F.col("x") > F.col("y")) & (F.col("rx") != F.col("ry")) & _near(similarity)).select("x", "y").distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = links.unionByName(materialize(_verified(pairs, sets, similarity), "near-links"))
        left = left if k == STARS else open_(links)
    return links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component left, as ``simhash.drop_near_duplicates``
    has it, where links are fingerprints within its radius and similar texts."""
    rows = materialize(signed(docs, id_col, text_col), "near-signed")
    known = materialize(simhash.near_pairs(rows.select("fp").distinct()), "near-known")
    named = simhash.named(rows.select("id", "fp"), similar_links(rows, known))
    return simhash.drop_classes(docs, rows.select("id", "fp"), named, id_col, text_col)
