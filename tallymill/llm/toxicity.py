"""Toxicity by a linear-chain conditional random field over words.

Two states, clean and toxic. A word's potential is the sum of the weights of its
own features (the word, its beginnings and ends, hashed into one table), states
of neighbours are tied by four transition weights. Forward-backward gives each
word's marginal; a document's score is a logistic function of sums of its
marginals, and the words whose marginal passes 0.5 are the offending offsets.

Token labels: the documents are labelled, words are not. In toxic documents of
the sample the words are marked that carry a feature found significantly often
in toxic documents and almost never in clean ones; all other words are clean.
The chain is trained on these labels by gradient ascent of the exact likelihood.

Training rows: at most ``SAMPLE`` toxic documents and three times as many clean ones, never held-out ones,
none over ``SAMPLE_BYTES`` (documented bounds; scoring covers whole texts of any
length). Long texts are cut into chunks whose 2 x 2 transfer matrices are
multiplied exactly, so a chunk's marginals are those of the whole chain.

Defined results: null and empty texts get the score of no words; rows that
repeat each get a row; null ids count as held out; without learnable labels of
both classes every score is the smoothed share of toxic rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import as_bytes
from tallymill.llm.decontaminate import words
from tallymill.llm.labelled import held_out, sample_ids, sample_rows

#: Toxic documents; of clean ones three times as many.
SAMPLE = 2000
SAMPLE_BYTES = 1 << 14
THRESHOLD = 0.5
#: The field climbs on windows of so many words, at most so many of them, of a document at most
#: so many around marked words and two spread ones; scoring has no such bounds.
WIDTH, WINDOWS, MARKED = 32, 16_000, 6
CHUNK = 128
#: Documents a feature must be in to get a weight: a part of the sample, within these bounds.
RARE = (3, 8)
#: How likely chance alone may explain a mark.
CHANCE = 1e-4
_TABLE = 1 << 18
#: The words of ``words`` in a text that keeps its case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def word_features(word: bytes) -> list[bytes]:
    """The word, its beginnings of 3 to 8 letters and ends of 3 and 4."""
    s = word.decode("utf-8", "replace")
    parts = [f"w{s}", *(f"p{s[:k]}" for k in (3, 4, 5, 6, 7, 8) if len(s) > k), *(f"s{s[-k:]}" for k in (3, 4) if len(s) > k)]
    return [p.encode() for p in parts]


def _slots(word: bytes) -> list[int]:
    return [crc32(f) % _TABLE for f in word_features(word)]


class Chain:
    """Weights of the field and of the document score."""

    def __init__(self):
        self.weight = np.zeros(_TABLE)
        self.bias = -4.0
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.doc = np.zeros(5)
        self.base = 0.0
        self.flat = True
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emission(self, word: bytes) -> float:
        """Log potential of toxic against clean."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[word] = float(self.weight[_slots(word)].sum() + self.bias)
        return got

    # --- inference -----------------------------------------------------------------

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Of each document, the toxic marginal of each word. Exact for any length."""
        sizes = np.array([len(e) for e in emissions], np.int64)
        if not sizes.sum():
            return [np.zeros(0) for _ in emissions]
        chunks = -(-sizes // CHUNK)
        first = np.concatenate(([0], np.cumsum(chunks)))
        grid = np.zeros((int(first[-1]), CHUNK))
        mask = np.zeros((int(first[-1]), CHUNK), bool)
        flat, token = np.concatenate(emissions), np.arange(int(sizes.sum()))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inner = token - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row, col = first[doc] + inner // CHUNK, inner % CHUNK
        grid[row, col], mask[row, col] = flat, True
        odds = np.exp(np.clip(grid, -30, 30))
        a = np.exp(self.trans)
        start = np.exp(self.start)
        # the first word of a document takes the start weights in place of a transition:
        # entering state (1, 0) with the row below gives exactly that
        used = np.flatnonzero(chunks)
        head = first[used]
        is_head = np.zeros(len(grid), bool)
        is_head[head] = True

        def step(left, right, t):
            """Row vectors (left, right) times the matrix of position t, where the mask holds."""
            at_head = is_head & (t == 0)
            x = np.where(at_head, left * start[0], left * a[0, 0] + right * a[1, 0])
            y = np.where(at_head, left * start[1], left * a[0, 1] + right * a[1, 1]) * odds[:, t]
            m = mask[:, t]
            return np.where(m, x, left), np.where(m, y, right)

        # 1. product of each chunk, from both entering states
        one, zero = np.ones(len(grid)), np.zeros(len(grid))
        p, q, r, s = one, zero, zero, one
        for t in range(CHUNK):
            p, q = step(p, q, t)
            r, s = step(r, s, t)
            scale = p + q + r + s
            p, q, r, s = p / scale, q / scale, r / scale, s / scale
        # 2. entering forward and leaving backward vectors, chunk after chunk of all documents
        enter, leave = np.zeros((len(grid), 2)), np.ones((len(grid), 2))
        enter[head, 0] = 1.0
        longest = int(chunks.max())
        by_size = used[np.argsort(-chunks[used], kind="stable")]
        count = np.sort(chunks[used])[::-1]
        for k in range(1, longest):
            d = by_size[: int(np.searchsorted(-count, -k, "left"))]
            now, was = first[d] + k, first[d] + k - 1
            x = enter[was, 0] * p[was] + enter[was, 1] * r[was]
            y = enter[was, 0] * q[was] + enter[was, 1] * s[was]
            enter[now, 0], enter[now, 1] = x / (x + y), y / (x + y)
        for k in range(longest - 2, -1, -1):
            d = by_size[: int(np.searchsorted(-count, -(k + 1), "left"))]
            now, then = first[d] + k, first[d] + k + 1
            x = p[then] * leave[then, 0] + q[then] * leave[then, 1]
            y = r[then] * leave[then, 0] + s[then] * leave[then, 1]
            leave[now, 0], leave[now, 1] = x / (x + y), y / (x + y)
        # 3. forward and backward inside the chunks
        share = np.zeros((CHUNK, len(grid)))
        left, right = enter[:, 0], enter[:, 1]
        for t in range(CHUNK):
            left, right = step(left, right, t)
            total = left + right
            left, right = left / total, right / total
            share[t] = right
        b0, b1 = leave[:, 0], leave[:, 1]
        out = np.zeros_like(grid)
        for t in range(CHUNK - 1, -1, -1):
            good, bad = (1 - share[t]) * b0, share[t] * b1
            out[:, t] = bad / (good + bad)
            m, o = mask[:, t], odds[:, t]
            n0, n1 = a[0, 0] * b0 + a[0, 1] * o * b1, a[1, 0] * b0 + a[1, 1] * o * b1
            total = n0 + n1
            b0, b1 = np.where(m, n0 / total, b0), np.where(m, n1 / total, b1)
        return np.split(out[row, col], np.cumsum(sizes)[:-1])

    @staticmethod
    def summary(marginal: np.ndarray) -> tuple[float, ...]:
        """What the document's score is made of."""
        if not len(marginal):
            return 0.0, 0.0, 0.0, -12.0, 1.0
        most = float(np.clip(marginal.max(), 1e-6, 1 - 1e-6))
        return float(np.log1p(marginal.sum())), most, float(np.log1p((marginal > 0.5).sum())), float(np.clip(np.log(most / (1 - most)), -12, 12)), 1.0

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.flat:
            return np.full(len(marginals), self.base)
        x = np.array([self.summary(m) for m in marginals]).reshape(len(marginals), 5)
        return 1 / (1 + np.exp(-np.clip(x @ self.doc, -35, 35)))

    # --- learning ------------------------------------------------------------------

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int]) -> Chain:
        self, y = cls(), np.array(labels, np.float64)
        self.base = float((y.sum() + 1) / (len(y) + 2))
        if not 0 < y.sum() < len(y):
            return self
        self.flat = False
        # words as numbers: each word's features are made once, the texts are small arrays
        number: dict[bytes, int] = {}
        tokens = []
        for t in texts:
            w = words(t)
            tokens.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int32, len(w)))
        own = _without_copies(tokens)
        if 0 < y[own].sum() < len(own):
            tokens, y = [tokens[k] for k in own], y[own]
        sample = _Sample(list(number), tokens, y)
        # the field learns from two thirds, the document's score from the rest, which the field has not seen
        third = np.arange(len(y)) % 3 == 0
        if not 0 < y[third].sum() < third.sum():
            third[:] = True
        self._climb(sample, np.flatnonzero(~third if not third.all() else third))
        power = np.add.reduceat(self.weight[sample.slots], sample.first[:-1]) + self.bias if len(sample.slots) else np.zeros(0)
        sums = np.array([self.summary(m) for m in self.marginals([power[tokens[k]] for k in np.flatnonzero(third)])])
        y = y[third]
        for _ in range(400):  # Newton steps with a weak prior
            p = 1 / (1 + np.exp(-np.clip(sums @ self.doc, -35, 35)))
            grad = sums.T @ (y - p) - 0.05 * self.doc
            hess = (sums * (p * (1 - p))[:, None]).T @ sums + 0.05 * np.eye(5)
            move = np.linalg.solve(hess, grad)
            self.doc += np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-6:
                break
        return self

    def _climb(self, sample: _Sample, chosen: np.ndarray, width: int = WIDTH, most: int = WINDOWS, rounds: int = 40) -> None:
        """Gradient ascent (Adagrad) on windows of the chosen documents: those
        around marked words and evenly spread ones."""
        rng = np.random.default_rng(7)
        spans = []
        for d in chosen.tolist():
            n = len(sample.tokens[d])
            if n:
                hits = np.flatnonzero(sample.state(d))
                starts = {max(0, int(h) - int(rng.integers(width))) for h in hits[:MARKED]} | {int(rng.integers(max(1, n - width + 1))) for _ in range(2)}
                spans += [(d, s) for s in sorted(starts)]
        spans = [spans[k] for k in np.sort(rng.permutation(len(spans))[:most])]
        n = len(spans)
        mask, z, word = np.zeros((n, width), bool), np.zeros((n, width)), np.zeros((n, width), np.int64)
        for i, (d, s) in enumerate(spans):
            part = sample.tokens[d][s : s + width]
            mask[i, : len(part)] = True
            word[i, : len(part)] = part
            z[i, : len(part)] = sample.state(d)[s : s + width]
        usable = sample.spread[sample.slots] >= min(RARE[1], max(RARE[0], len(sample.y) // 800))
        met, back = np.unique(word[mask], return_inverse=True)
        # features of the words met, once each; gradients gather by word first
        sizes = np.diff(sample.first)[met]
        slot_at = np.repeat(sample.first[met], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owner = np.repeat(np.arange(len(met)), sizes)[usable[slot_at]]
        slot = sample.slots[slot_at[usable[slot_at]]]
        pair = mask[:, 1:] & mask[:, :-1]
        seen_trans = np.array([[(((1 - z[:, :-1]) if i == 0 else z[:, :-1]) * ((1 - z[:, 1:]) if j == 0 else z[:, 1:]) * pair).sum() for j in (0, 1)] for i in (0, 1)])
        power_w, power_t, power_b = np.full(_TABLE, 1e-8), np.full((2, 2), 1e-8), 1e-8
        e = np.zeros((n, width))
        for _ in range(rounds):
            e[mask] = (np.bincount(owner, self.weight[slot], len(met)) + self.bias)[back]
            odds, a = np.exp(np.clip(e, -30, 30)), np.exp(self.trans)
            f = np.zeros((width, n, 2))
            x, v = np.ones(n), odds[:, 0]
            for t in range(width):
                if t:
                    nx, nv = x * a[0, 0] + v * a[1, 0], (x * a[0, 1] + v * a[1, 1]) * odds[:, t]
                    x, v = np.where(mask[:, t], nx, x), np.where(mask[:, t], nv, v)
                total = x + v
                x, v = x / total, v / total
                f[t, :, 0], f[t, :, 1] = x, v
            b = np.ones((n, 2))
            share, want_trans = np.zeros((n, width)), np.zeros((2, 2))
            for t in range(width - 1, -1, -1):
                good, bad = f[t, :, 0] * b[:, 0], f[t, :, 1] * b[:, 1]
                share[:, t] = bad / (good + bad)
                if t:
                    o = odds[:, t]
                    cell = np.stack([f[t - 1, :, 0] * a[0, 0] * b[:, 0], f[t - 1, :, 0] * a[0, 1] * o * b[:, 1], f[t - 1, :, 1] * a[1, 0] * b[:, 0], f[t - 1, :, 1] * a[1, 1] * o * b[:, 1]])
                    want_trans += ((cell / cell.sum(0)) * mask[:, t]).sum(1).reshape(2, 2)
                    nb = np.stack([a[0, 0] * b[:, 0] + a[0, 1] * o * b[:, 1], a[1, 0] * b[:, 0] + a[1, 1] * o * b[:, 1]], 1)
                    nb /= nb.sum(1, keepdims=True)
                    b = np.where(mask[:, t, None], nb, b)
            miss = (z - share)[mask]
            gw = np.bincount(slot, np.bincount(back, miss, len(met))[owner], _TABLE) - 0.05 * self.weight
            gt, gb = seen_trans - want_trans - 0.05 * self.trans, miss.sum()
            power_w += gw**2
            power_t += gt**2
            power_b += gb**2
            self.weight += 0.5 * gw / np.sqrt(power_w)
            self.trans += 0.2 * gt / np.sqrt(power_t)
            self.bias += 0.2 * gb / np.sqrt(power_b)
        self.known.clear()


def _without_copies(tokens: list[np.ndarray]) -> list[int]:
    """Documents of the sample that are no near copies of earlier ones: the words
    of one text copied many times would look like marks of its class. Copies
    share one of four minima over hashed four-word runs."""
    seen: set[tuple[int, int]] = set()
    keep = []
    masks = np.random.default_rng(3).integers(0, 1 << 63, 4).astype(np.uint64)
    for d, t in enumerate(tokens):
        x = t.astype(np.uint64) + np.uint64(1)
        runs = np.zeros(max(1, len(x) - 3), np.uint64)
        for k in range(min(4, len(x))):
            runs = (runs ^ x[k : k + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(29)
        marks = {(k, int((runs ^ m).min())) for k, m in enumerate(masks)}
        if seen.isdisjoint(marks):
            keep.append(d)
        seen |= marks
    return keep


class _Sample:
    """Numbered training texts with the features of each word.

    ``slots[first[w] : first[w + 1]]`` are the table slots of word w, ``spread``
    the documents of each slot. A word of a toxic document is marked if one of
    its features is in so many toxic documents, and next to no clean ones, that
    chance does not explain it.
    """

    def __init__(self, vocab: list[bytes], tokens: list[np.ndarray], y: np.ndarray):
        self.tokens, self.y = tokens, y
        listed = [_slots(w) for w in vocab]
        self.first = np.concatenate(([0], np.cumsum([len(s) for s in listed]))).astype(np.int64)
        self.slots = np.array([k for s in listed for k in s], np.int64)
        seen = np.zeros((2, _TABLE), np.int64)
        for t, label in zip(tokens, y):
            if len(t):
                here = np.unique(np.concatenate([self.slots[self.first[w] : self.first[w + 1]] for w in np.unique(t)]))
                seen[int(label), here] += 1
        self.spread = seen.sum(axis=0)
        clean, toxic = len(y) - y.sum(), y.sum()
        marks = (seen[1] * np.log(y.mean()) < np.log(CHANCE)) & (seen[0] <= 0.02 * seen[1] * clean / toxic)
        self.marked = np.maximum.reduceat(marks[self.slots], self.first[:-1]) if len(self.slots) else np.zeros(0, bool)

    def state(self, d: int) -> np.ndarray:
        """Token labels of a document."""
        return self.marked[self.tokens[d]] if self.y[d] else np.zeros(len(self.tokens[d]), bool)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """At most four times ``sample`` texts of at most ``SAMPLE_BYTES`` reach the driver."""
    short = docs.where(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) <= SAMPLE_BYTES)
    rows = sample_rows(short, sample_ids(labels, label_col, {0: 3 * sample, 1: sample}, id_col), text_col, id_col)
    one = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    got = sorted(one.collect(), key=lambda r: r.id)
    return Chain.fit([r.text.encode() for r in got], [r.label for r in got])


SCHEMA = "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>"


def score_toxicity(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)``; ``spans`` are the offending
    words in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, fixed by the table's size
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # bounds the words held at once
                part = batch.slice(at, 1000)
                texts = as_bytes(part.column(1))
                emissions = [np.fromiter(map(chain.emission, w), np.float64, len(w)) for w in map(words, texts)]
                marginal = chain.marginals(emissions)
                spans = []
                for text, m in zip(texts, marginal):
                    hits = set(np.flatnonzero(m > 0.5).tolist()) if len(m) and m.max() > 0.5 else ()
                    spans.append([{"start": w.start(), "end": w.end(), "p": float(m[k])} for k, w in enumerate(_WORD.finditer(text.decode())) if k in hits] if hits else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chain.score(marginal)), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = src.mapInArrow(run, SCHEMA)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
