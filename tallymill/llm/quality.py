"""Quality classifier: a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one over the bins of each feature, and one
over the bin pairs of the strongest interactions. The tables are learnt by
cyclic boosting: round after round every feature in turn gets a shallow tree of
the current logistic gradient, shrunk and added to its table; then the chosen
pairs likewise. Scoring is bin lookup and addition over arrays.

Features are counts and ratios of the whole text (``FEATURES``); no id, source,
language or label enters. Labels come from a sample of at most ``SAMPLE`` rows
of each class (the documented bound), never from held-out rows.

Defined results: a null text is an empty one and gets the score of its
features; rows that repeat each get a row; null ids count as held out; without
any learnable label of both classes the score is the smoothed share of the class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import as_bytes, output_name
from tallymill.llm.labelled import held_out, sample_ids, sample_rows

SAMPLE = 10_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "exclamations", "bars", "symbols", "stops", "non_ascii", "controls",
    "distinct_words", "top_word", "repeats", "long_words", "short_words", "log_lines", "line_length", "distinct_lines", "brackets", "capital_words",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~_=+\\/", np.uint8)


def features(text: bytes | None) -> tuple[float, ...]:
    """``FEATURES`` of one text in UTF-8."""
    text = text or b""
    n = max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    often = Counter(words)
    lines = text.split(b"\n")
    upper, letters = int(count[65:91].sum()), int(count[65:91].sum() + count[97:123].sum() + count[192:].sum())
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return (
        log1p(len(text)), log1p(len(words)), float(sizes.mean()) if len(words) else 0.0, upper / max(1, letters), int(count[48:58].sum()) / n,
        int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / n, int(count[33]) / m, int(count[124]) / m,
        int(count[_SYMBOLS].sum()) / m, int(count[46]) / m, int(count[128:].sum()) / n, int(count[:9].sum() + count[14:32].sum() + count[127]) / n,
        len(often) / m, (max(often.values()) if words else 0) / m, sum(map(eq, words, words[1:])) / m, int((sizes > 20).sum()) / m, int((sizes < 4).sum()) / m,
        log1p(len(lines)), len(text) / len(lines), len(set(lines)) / len(lines), int(count[[40, 41, 60, 62, 91, 93, 123, 125]].sum()) / m,
        sum(map(bytes.istitle, words)) / m,
    )


class Gam:
    """Lookup tables of single features and of pairs."""

    BINS, PAIR_BINS, PAIRS = 48, 8, 12
    ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.12, 3

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """Learns from rows ``x`` (features) and labels ``y`` (0 or 1)."""
        y = y.astype(np.float64)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        d = x.shape[1]
        cut = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1])) if len(v) else np.zeros(0)
        self.cuts = [cut(x[:, j], self.BINS) for j in range(d)]
        self.coarse = [cut(x[:, j], self.PAIR_BINS) for j in range(d)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not 0 < y.sum() < len(y):
            return
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        score = np.full(len(y), self.base)
        for _ in range(self.ROUNDS):
            for j in range(d):
                g, h = self._slope(y, score)
                step = self._tree(np.bincount(bins[j], g, len(self.tables[j])), np.bincount(bins[j], h, len(self.tables[j])), self.LEAVES)
                self.tables[j] += step
                score += step[bins[j]]
        coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
        side = self.PAIR_BINS
        g, h = self._slope(y, score)
        found = []
        for i in range(d):
            for j in range(i + 1, d):
                code = coarse[i] * side + coarse[j]
                gg, hh = np.bincount(code, g, side * side).reshape(side, side), np.bincount(code, h, side * side).reshape(side, side)
                found.append((self._cross(gg, hh)[0], i, j))
        self.pairs = [(i, j) for gain, i, j in sorted(found, reverse=True)[: self.PAIRS] if gain > 0]
        self.pair_tables = [np.zeros((side, side)) for _ in self.pairs]
        for _ in range(self.PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                g, h = self._slope(y, score)
                code = coarse[i] * side + coarse[j]
                step = self._cross(np.bincount(code, g, side * side).reshape(side, side), np.bincount(code, h, side * side).reshape(side, side))[1]
                table += step
                score += step[coarse[i], coarse[j]]

    @staticmethod
    def _slope(y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    def _tree(self, g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
        """Step of each bin from a tree of so many leaves on one feature's histogram."""
        spans, soft = [(0, len(g))], 5.0
        cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
        while len(spans) < leaves:
            best = (1e-9, None)
            for s, e in spans:
                if e - s < 2:
                    continue
                k = np.arange(s + 1, e)
                gl, hl, ga, ha = cg[k] - cg[s], ch[k] - ch[s], cg[e] - cg[s], ch[e] - ch[s]
                gain = gl**2 / (hl + soft) + (ga - gl) ** 2 / (ha - hl + soft) - ga**2 / (ha + soft)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), (s, int(k[at]), e))
            if best[1] is None:
                break
            s, k, e = best[1]
            spans.remove((s, e))
            spans += [(s, k), (k, e)]
        step = np.zeros(len(g))
        for s, e in spans:
            step[s:e] = self.RATE * (cg[e] - cg[s]) / (ch[e] - ch[s] + soft)
        return step

    def _cross(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Best tree of one cut on each of two features: its gain over the best
        cut-free step and the step of each cell."""
        soft = 5.0
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        total_g, total_h = cg[-1, -1], ch[-1, -1]
        a, b = np.meshgrid(np.arange(g.shape[0] - 1), np.arange(g.shape[1] - 1), indexing="ij")
        quads = []
        for c, t in ((cg, total_g), (ch, total_h)):
            q = c[a, b]
            top, left = c[a, -1], c[-1, b]
            quads.append((q, top - q, left - q, t - top - left + q))
        gain = sum(x**2 / (y + soft) for x, y in zip(*quads)) - total_g**2 / (total_h + soft)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        step = np.zeros_like(g)
        for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
            step[rows, cols] = self.RATE * quads[0][k][i, j] / (quads[1][k][i, j] + soft)
        return float(gain[i, j]), step

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables)):
            total += t[np.searchsorted(c, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array(list(map(features, texts)), np.float64).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """The features of the sample are made on the executors; at most two times
    ``sample`` rows of numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "x"])

    rows = sample_rows(docs, sample_ids(labels, label_col, {0: sample, 1: sample}, id_col), text_col, id_col)
    known = rows.mapInArrow(run, "id long, label int, x array<double>").groupBy("id").agg(F.min(F.struct("x", "label")).alias("r")).select("id", "r.x", "r.label")
    got = sorted(known.collect(), key=lambda r: r.id)
    x = np.array([r.x for r in got], np.float64).reshape(len(got), len(FEATURES))
    return Gam(x, np.array([r.label for r in got], np.int64))


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(as_bytes(batch.column(1)))))], names=["doc_id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = src.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; no shuffle."""
    where = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(_matrix(as_bytes(batch.column(where)))) >= threshold
            yield pa.RecordBatch.from_arrays(batch.columns[:where], names=batch.schema.names[:where]).filter(pa.array(good))

    return docs.withColumn(output_name(docs.columns, "probe"), F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
