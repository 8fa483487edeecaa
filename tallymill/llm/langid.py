"""Language identification: averaged hashed subword embeddings, a linear softmax.

A text is the mean of the embeddings of its subwords: runs of 1 to ``ORDER``
characters inside its words, with the word's borders as characters, hashed to
``BUCKETS`` rows. A linear layer and a softmax give the languages. Both are learnt
by stochastic gradient descent in numpy over a sample of at most ``SAMPLE`` texts of
each language (the documented bound; lowest hash of the id first), whose bags of
subwords are made on the executors. A fifth of the sample is not learnt from: on it a
temperature is fitted, which makes scores probabilities, and the score is found
from which on the share of right answers is ``PRECISION``; texts below are rejected.

Scoring folds both layers into one table (a row of logits for each bucket), so a text
is a mean of looked-up rows. Whole texts count, in slices.

Defined results: a null text and one without a letter are ``und`` with score 0; texts
that repeat get equal rows; null ids are held out; rows of null lang are never learnt
from; an id with two languages is learnt in both; without anything to learn from all texts are
``und``; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.labelled import held_out, low_hashes

SAMPLE = 1_000
ORDER, BUCKETS, WIDTH = 4, 1 << 16, 16
#: ``STEP`` is what a row of the embedding moves by beside the linear layer: of a text's
#: many subwords each has but a small share in its mean.
EPOCHS, RATE, STEP, BATCH = 8, 1.0, 100.0, 8
PRECISION = 0.99
UNKNOWN = "und"
#: Characters whose subwords are looked up at once.
SLICE = 1 << 19
_BORDER = 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), np.bool_)
    return _letters


def subwords(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, bucket)`` of every subword of the texts, in slices."""
    is_letter = letters()
    held: list[tuple[int, str]] = []

    def codes(parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return c, np.repeat([r for r, _ in parts], [len(p) for _, p in parts])

    def hashed(c: np.ndarray, row: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Subwords that start at the first ``n`` places; a border stands at both ends of each text."""
        inside = is_letter[c]
        x = np.where(inside, c, _BORDER).astype(np.uint64)
        h = np.zeros(len(x), np.uint64)
        for k in range(ORDER):
            m = min(n, len(x) - k)
            if m <= 0:
                break
            h = h[:m] + x[k : k + m] * _MIX[k]
            # a border is at most the first or the last character of a run
            ok = inside[:m] if k == 0 else inside[:m] | inside[1 : m + 1] if k == 1 else inside[1 : m + 1] & inside[k - 1 : m + k - 1]
            at = np.flatnonzero(ok)
            mixed = (h[at] ^ (h[at] >> np.uint64(29))) * _MIX[0]
            yield row[at + (~inside[at])], (mixed >> np.uint64(48)).astype(np.int64)

    total = 0
    for r, t in enumerate(texts):
        if not t:
            continue
        t = f" {t.lower()} "
        if len(t) > size:
            for s in range(0, len(t), size):
                c, row = codes([(r, t[s : s + size + ORDER - 1])])
                yield from hashed(c, row, size)
            continue
        held.append((r, t))
        total += len(t)
        if total >= size:
            c, row = codes(held)
            yield from hashed(c, row, len(c))
            held, total = [], 0
    if held:
        c, row = codes(held)
        yield from hashed(c, row, len(c))


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and how often it has each."""
    out = []
    for t in texts:
        count = np.zeros(BUCKETS, np.int64)
        for _, bucket in subwords([t]):
            count += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(count)
        out.append((at.astype(np.int32), count[at].astype(np.int32)))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    """Names, the folded table ``(BUCKETS + 1, names)`` whose last row is the bias, and
    the temperature and score of the calibration."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7):
        """Learns from ``(language, buckets, counts)``; every fifth row calibrates."""
        self.names = sorted({r[0] for r in rows})
        self.temperature, self.least = 1.0, 0.0
        k = len(self.names)
        if not k:
            self.table = np.zeros((BUCKETS + 1, 0))
            return
        rng = np.random.default_rng(seed)
        embed, linear, bias = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)), np.zeros((WIDTH, k)), np.zeros(k)
        data = [(self.names.index(name), at, n / n.sum()) for name, at, n in rows if len(at)]
        fit = [d for i, d in enumerate(data) if i % 5 or len(data) < 10]
        weight = len(fit) / (k * np.maximum(1, np.bincount([d[0] for d in fit], minlength=k)))
        for epoch in range(EPOCHS):
            order = rng.permutation(len(fit))
            for s in range(0, len(order), BATCH):
                rate = RATE * (1 - (epoch * len(order) + s) / (EPOCHS * len(order)))
                batch = [fit[i] for i in order[s : s + BATCH]]
                mean = np.stack([share @ embed[at] for _, at, share in batch])
                slope = softmax(mean @ linear + bias)
                slope[np.arange(len(batch)), [d[0] for d in batch]] -= 1
                slope *= weight[[d[0] for d in batch]][:, None] / len(batch)
                back = slope @ linear.T
                linear -= rate * mean.T @ slope
                bias -= rate * slope.sum(axis=0)
                for (_, at, share), g in zip(batch, back):
                    embed[at] -= STEP * rate * share[:, None] * g
        seen = np.zeros(BUCKETS, np.bool_)
        for _, at, _ in fit:
            seen[at] = True
        # a bucket that was never learnt holds its random start only, so it speaks for no language
        self.table = np.vstack((embed @ linear * seen[:, None], bias))
        self._calibrate([d for i, d in enumerate(data) if not i % 5])

    def _calibrate(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        if not rows:
            return
        logits = np.stack([share @ self.table[at] + self.table[-1] for _, at, share in rows])
        want = np.array([r[0] for r in rows])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(want)), want] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(1, 50, 121), key=loss))  # never sharper than learnt
        p = softmax(logits / self.temperature)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = np.cumsum(p.argmax(axis=1)[order] == want[order]) / np.arange(1, len(order) + 1)
        fit = np.flatnonzero(right >= PRECISION)
        self.least = float(p.max(axis=1)[order][fit[-1]]) if len(fit) else 1.0

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: none) and score of each text."""
        k, n = len(self.names), np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), k))
        for row, bucket in subwords(texts):
            n += np.bincount(row, minlength=len(texts))
            for j in range(k):
                sums[:, j] += np.bincount(row, self.table[bucket, j], len(texts))
        if not k:
            return np.full(len(texts), -1), np.zeros(len(texts))
        p = softmax((sums / np.maximum(n, 1)[:, None] + self.table[-1]) / self.temperature)
        return np.where(n > 0, p.argmax(axis=1), -1), np.where(n > 0, p.max(axis=1), 0.0)


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Two columns of ids and languages choose the sample; the bags of its texts, at most
    ``sample`` for each language, reach the driver."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = src.where(F.col("lang").isNotNull() & ~held_out("id"))
    ids = known.select("id", "lang").distinct()
    order = F.xxhash64(F.lit("language"), F.col("id"))
    totals = {r.lang: r["count"] for r in ids.groupBy("lang").count().collect()}
    if not totals:
        return LanguageModel([])
    low = F.lit(False)
    for lang, n in totals.items():
        low |= (F.col("lang") == lang) & low_hashes(order, sample, n)
    found: dict[str, list] = {}
    for r in ids.where(low).select("lang", "id", order.alias("o")).collect():  # some 1.5 * sample numbers for each language
        found.setdefault(r.lang, []).append((r.o, r.id))
    picked = [(i, lang) for lang, rows in found.items() for _, i in sorted(rows)[:sample]]
    chosen = docs.sparkSession.createDataFrame(picked, "id long, lang string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = bags(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([at.tobytes() for at, _ in made], pa.binary()), pa.array([n.tobytes() for _, n in made], pa.binary())], names=["id", "lang", "at", "n"]
            )

    # one text of each id, so repeated rows do not swell the sample
    texts = known.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).where("text is not null")
    got = sorted(texts.mapInArrow(run, "id long, lang string, at binary, n binary").collect(), key=lambda r: (r.id, r.lang))
    return LanguageModel([(r.lang, np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int32)) for r in got])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([UNKNOWN, *model.names], pa.string())
        for batch in batches:
            best, score = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(best + 1)), pa.array(score), pa.array((best >= 0) & (score >= model.least))], names=["doc_id", "lang_pred", "score", "accepted"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")
