"""Source divergence audit: how far the terms of a source are from its language's.

Every (lang, source) group, and each language, gives each kept term a whole-number
probability ``p = 1 + floor(SCALE * (count + 1) / (N + V))``; a term kept by a language is in at least
``LEAST_DOCS`` of its documents, V is their number, N what they count in the
group. ``f(p, q) = floor((p - q)^2 / q)``. Part ``pair`` sums f between two sources
over all kept terms, part ``term`` lists a group's terms of highest f against the
language, among those it holds more often.

*Terms.* A group's terms of one count share p, and f falls as q rises to p, so the
rarest term of such a bucket bounds f for the whole bucket. Buckets are evaluated
best bound first, in two rounds: the buckets in front that hold ``TOP`` terms give a
k-th value, then those whose bound is not strictly below it follow; of the rest no
term can enter.

*Pairs.* f of terms that a side lacks depends on the other side's count alone, so
histograms of counts give the sum as if no term were shared; postings (the groups of
each term) correct it for the terms that both hold. No row is made for a pair and a
term: tasks add up arrays. Sums stay below ``(V + SCALE)^2``, inside 64 bits for V
up to two thousand million.

Defined results: null text, lang and source are ''; a group without kept terms has
count 0 everywhere; a language without kept terms has pairs of value 0 and no terms;
rows that repeat are documents of their own; equal values rank by the item's UTF-8;
an empty table gives no rows; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import LOWER, discard, materialize, pieces

TOP, LEAST_DOCS, SCALE = 200, 3, 1_000_000_000
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Rows of group or bucket statistics that are broadcast; beyond it they are shuffled.
SMALL = 200_000
#: Distinct (group, term) counts that a task holds before it hands them on.
HELD = 1_000_000
#: Pairs of groups in one array.
CELLS = 2_000_000


def probability(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + kept))``, exactly."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    return (1 + F.call_function("div", (whole(n) + 1).cast("decimal(20,0)") * F.lit(SCALE), whole(total) + whole(kept))).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, n, docs)`` of the texts of a task."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            terms = list(n)
            for s in range(0, len(terms), 100_000):
                part = terms[s : s + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
        seen.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            own: Counter = Counter()
            for piece in pieces(text, TERM):
                own.update(TERM.findall(piece.translate(LOWER)))
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(own)
            docs.update(own.keys())
            held += len(n) - before
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def _absent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of f as if no term were shared: each group against all of its language."""
    for batch in batches:
        for lang, own, kept, terms, ps, ks, zeros in zip(*(c.to_pylist() for c in batch.columns)):
            p0 = np.array(zeros, np.int64)
            p, k = np.array(ps or (), np.int64), np.array(ks or (), np.int64)
            there, back = np.zeros(len(p0), np.int64), np.zeros(len(p0), np.int64)
            step = max(1, CELLS // len(p0))
            for s in range(0, len(p), step):
                q, w = p[s : s + step, None], k[s : s + step, None]
                square = (q - p0) ** 2
                there += (square // p0 * w).sum(axis=0)
                back += (square // q * w).sum(axis=0)
            square = (p0[own - 1] - p0) ** 2
            there += square // p0 * (kept - terms)
            back -= square // p0[own - 1] * terms
            at, one = np.arange(1, len(p0) + 1), np.full(len(p0), own)
            other = at != own
            a, b = np.concatenate((one[other], at[other])), np.concatenate((at[other], one[other]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(np.concatenate((there[other], back[other])))], names=["lang", "a", "b", "v"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a term that two groups share adds to the sums of ``_absent``."""
    f = lambda p, q: (p - q) ** 2 // q
    for batch in batches:
        if not len(batch):
            continue
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat = lists.flatten()
        ids, p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "p", "p0"))
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        mates, code = np.repeat(sizes, sizes), np.repeat(code, sizes)
        ends = np.cumsum(mates)
        base, s = int(ids.max(initial=0)) + 1, 0
        while s < len(ids):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + CELLS, "right")))
            i = np.repeat(np.arange(s, e), mates[s:e])
            j = start[i] + np.arange(len(i)) - np.repeat(ends[s:e] - mates[s:e] - (ends[s - 1] if s else 0), mates[s:e])
            i, j = i[i != j], j[i != j]
            v = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            keys, at = np.unique((code[i] * base + ids[i]) * base + ids[j], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, v)
            names = langs.dictionary.take(pa.array(keys // (base * base)))
            yield pa.RecordBatch.from_arrays([names, pa.array(keys // base % base), pa.array(keys % base), pa.array(sums)], names=["lang", "a", "b", "v"])
            s = e


class Audit:
    """Counts of one corpus, written to the shared folder, and what follows from them."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS):
        self.spark = docs.sparkSession
        said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        src = docs.select(said(lang_col).alias("lang"), said(source_col).alias("source"), said(text_col).alias("text"))
        counts = src.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
        # tasks have added up their own rows, so one shuffle by term serves both sums
        each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        posted = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
        kept = posted.where(F.col("docs") >= least_docs)
        #: ``(tid, lang, term, total, held)`` of every kept term.
        self.postings = materialize(kept.select(F.monotonically_increasing_id().alias("tid"), "lang", "term", "total", "held"), "postings")
        hist = self.rows().groupBy("lang", "source", "n").agg(F.count("*").alias("k"), F.min("total").alias("rarest"))
        #: ``(lang, source, n, k, rarest)``: the terms of each count in a group.
        self.hist = materialize(hist, "histogram")
        sums = self.hist.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("k")).alias("n_group"), F.sum("k").alias("terms"))
        langs = self.postings.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("n_lang"))
        found = src.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
        found = found.withColumn("p0", F.when(F.col("kept") > 0, probability(F.lit(0), "n_group", F.when(F.col("kept") > 0, F.col("kept")).otherwise(1))).otherwise(1))
        found = found.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
        #: A row for each group; ``id`` counts the sources of a language.
        self.groups = materialize(found, "groups")
        self.tables = [self.postings, self.hist, self.groups]

    def rows(self) -> DataFrame:
        return self.postings.select("tid", "lang", "term", "total", F.explode("held").alias("e")).select("tid", "lang", "term", "total", "e.source", "e.n")

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= SMALL else df

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables.append(materialize(df, tag))
        return self.tables[-1]

    def term_rows(self, top: int = TOP) -> DataFrame:
        """``(lang, source, item, value)``: the terms of highest f of each group."""
        stats = self.hist.join(self.groups.select("lang", "source", "n_group", "kept", "n_lang"), ["lang", "source"])
        bounds = stats.withColumn("p", probability("n", "n_group", "kept")).withColumn("q", probability("rarest", "n_lang", "kept"))
        bounds = bounds.where("p > q").withColumn("bound", distance(F.col("p"), F.col("q")))
        best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
        bounds = self.keep(bounds.withColumn("before", F.coalesce(F.sum("k").over(best_first), F.lit(0))).select("lang", "source", "n", "p", "kept", "n_lang", "bound", "before"), "bounds")

        def evaluated(buckets: DataFrame) -> DataFrame:
            met = self.rows().join(self.small(buckets.select("lang", "source", "n", "p", "kept", "n_lang")), ["lang", "source", "n"])
            met = met.withColumn("q", probability("total", "n_lang", "kept")).where("p > q")
            return met.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= top)
        first = self.keep(best(evaluated(bounds.where(F.col("before") < top))), "best-terms")
        kth = first.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
        unseen = bounds.where(F.col("before") >= top).join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth")
        return best(first.drop("rank").unionByName(evaluated(unseen))).drop("rank")

    def pair_rows(self) -> DataFrame:
        """``(lang, source, item, value)``: the sum of f of each two sources of a language."""
        stats = self.groups.select("lang", "source", "id", "kept", "n_group", "terms", "p0")
        bins = self.hist.join(stats.select("lang", "source", "n_group", "kept"), ["lang", "source"]).select("lang", "source", F.struct(probability("n", "n_group", "kept").alias("p"), "k").alias("e"))
        bins = bins.groupBy("lang", "source").agg(F.collect_list("e").alias("bins"))
        zeros = stats.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "p0"))), lambda x: x["p0"]).alias("zeros"))
        lone = stats.join(bins, ["lang", "source"], "left").join(zeros, "lang").select("lang", "id", "kept", "terms", F.col("bins.p").alias("p"), F.col("bins.k").alias("k"), "zeros")
        of = "lang string, a long, b long, v long"
        held = self.rows().join(self.small(stats.where("terms > 0")), ["lang", "source"])
        held = held.select("tid", "lang", F.struct("id", probability("n", "n_group", "kept").alias("p"), "p0").alias("e"))
        held = held.groupBy("tid").agg(F.first("lang").alias("lang"), F.collect_list("e").alias("e")).where(F.size("e") > 1).select("lang", "e")
        sums = lone.mapInArrow(_absent, of).unionByName(held.mapInArrow(_shared, of)).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
        name = lambda at, c: stats.select("lang", F.col("id").alias(at), F.col("source").alias(c))
        return sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of both parts."""
    a = Audit(docs, text_col, lang_col, source_col, least_docs)
    parts = a.pair_rows().withColumn("part", F.lit("pair")).unionByName(a.term_rows(top).withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = materialize(parts.select("lang", "source", "part", "item", "value", rank.alias("rank")), "divergence")
    for t in a.tables:
        discard(a.spark, t.scratch)
    return out
