"""Benchmark decontamination with suffix arrays over shards of the corpus.

The words of a shard (documents up to ``SHARD`` words, longer ones alone) are
numbered by the benchmark's vocabulary; a word the benchmark lacks ends every
match and is 0. The shard's suffixes that could hold a window are sorted by
their leading words, several words to a 64-bit key; every test suffix with a
window (``WINDOW`` words, or all of a shorter item) is then binary-searched: key by
key its interval of the suffix array narrows until it spans the window; suffixes
that begin alike are searched once. All suffixes of the interval are places of the
window. Places of successive suffixes of *one* item on one diagonal are one
verbatim match, so its length and location are exact for each item.

A benchmark of up to ``BLOCK_BYTES`` of text is one block, which is broadcast, and
the documents stream through once without a shuffle. A larger one is cut by hash
into blocks of about that size, of which one at a time is gathered, broadcast and
passed over the documents; only rows with hits are kept of each pass (in the shared
folder), and they are merged by document at the end. No state between tasks.

Defined results: null or empty texts have no words and are clean; null or empty
items have no windows; items of null id mark words but are not counted; ids that
repeat count once; rows that repeat each get a row; other columns are not read
by ``contamination`` and pass through ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import as_bytes, discard, materialize, output_name, slices

WINDOW = 10
SHARD = 1 << 20
BLOCK_BYTES = 8 << 20
PART = 1 << 18
#: Bytes of text of which the words are numbered and sorted at once where rows are removed.
SLICE = 1 << 20
_NOT_WORD = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_TABLE = bytes.maketrans(bytes(range(0x41, 0x5B)) + _NOT_WORD, bytes(range(0x61, 0x7B)) + b" " * len(_NOT_WORD))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and all that is not ASCII."""
    return text.translate(_TABLE).split() if text else []


class Tests:
    """The test suffixes of one block: numbered words, windows and their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        by_text: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            if w := tuple(words(text)):
                by_text.setdefault(w, set()).update([] if item is None else [item])
        self.vocab: dict[bytes, int] = {}
        owner: dict[tuple[int, ...], list[int]] = {}
        self.items: list[set[str]] = []
        number: dict[tuple[int, ...], int] = {}
        starts: list[int] = []  # of each window's suffixes, by their order in the block
        which: list[int] = []
        at = 0
        for k, (w, ids) in enumerate(by_text.items()):
            self.items.append(ids)
            nums = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
            size = min(window, len(nums))
            for p in range(len(nums) - size + 1):
                win = tuple(nums[p : p + size])
                which.append(number.setdefault(win, len(number)))
                starts.append(at + p)
                if k not in (got := owner.setdefault(win, [])):
                    got.append(k)
            at += len(nums) + 1
        self.windows = list(number)
        self.owner = [owner[w] for w in self.windows]
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.least = int(self.size.min()) if self.windows else 0
        self.bits = max(1, len(self.vocab).bit_length())
        self.per_key = 63 // self.bits
        #: The keys that begin with each window's words from a depth on, as bounds for each depth.
        self.bounds = [self._bounds(depth) for depth in range(0, int(self.size.max()) if self.windows else 0, self.per_key)]
        #: The test suffixes that begin with each window: ``suffixes[heads[w] : heads[w + 1]]``.
        order = np.argsort(np.array(which, np.int64), kind="stable")
        self.suffixes = np.array(starts, np.int64)[order]
        self.heads = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(self.windows))))).astype(np.int64) if which else np.zeros(1, np.int64)

    def _bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(self.windows), np.int64), np.zeros(len(self.windows), np.int64)
        for k, window in enumerate(self.windows):
            chunk, value = window[depth : depth + self.per_key], 0
            for x in chunk:
                value = value << self.bits | x
            rest = self.bits * (self.per_key - len(chunk))
            low[k], high[k] = value << rest, (value + 1 << rest) - 1
        return low, high

    def places(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position, window)`` of every place of every window in a shard whose
        documents are parted by zeros; sorted by position."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.windows or not len(text):
            return none
        # room: words until the next zero; a suffix with less than the shortest window holds none
        zero = np.flatnonzero(text == 0)
        after = np.searchsorted(zero, np.arange(len(text)))
        room = np.append(zero, len(text))[after] - np.arange(len(text))
        suffix = np.flatnonzero(room >= self.least)
        if not len(suffix):
            return none
        padded = np.concatenate((text.astype(np.int64), np.zeros(self.per_key + self.window, np.int64)))
        group = np.zeros(len(suffix), np.int64)  # interval of the array a suffix is in, by the words so far
        alive = {0: np.arange(len(self.windows))}  # windows in each interval
        found_at, found_win, depth = [], [], 0
        while len(suffix) and alive:
            key = np.zeros(len(suffix), np.int64)
            for k in range(self.per_key):
                key = key << self.bits | padded[suffix + depth + k]
            order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
            suffix, group, key = suffix[order], group[order], key[order]
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if depth else np.array([0])
            tails = np.append(heads[1:], len(group))
            keep, new_group, new_alive, n = [], [], {}, 0
            for lo, hi, g in zip(heads.tolist(), tails.tolist(), group[heads].tolist()):
                part, wins = key[lo:hi], alive[g]
                low, high = self.bounds[depth // self.per_key]
                at = np.searchsorted(part, low[wins], "left")
                to = np.searchsorted(part, high[wins], "right")
                met = np.flatnonzero(at < to)
                nexts: dict[tuple[int, int], list[int]] = {}
                for w, s, e in zip(wins[met].tolist(), at[met].tolist(), to[met].tolist()):
                    if len(self.windows[w]) <= depth + self.per_key:
                        found_at.append(suffix[lo + s : lo + e])
                        found_win.append(np.full(e - s, w))
                    else:
                        nexts.setdefault((s, e), []).append(w)
                for (s, e), ws in nexts.items():
                    keep.append(suffix[lo + s : lo + e])
                    new_group.append(np.full(e - s, n))
                    new_alive[n] = np.array(ws)
                    n += 1
            suffix = np.concatenate(keep) if keep else none[0]
            group = np.concatenate(new_group) if keep else none[0]
            alive, depth = new_alive, depth + self.per_key
        if not found_at:
            return none
        at, win = np.concatenate(found_at), np.concatenate(found_win)
        order = np.lexsort((win, at))
        return at[order], win[order]

    def longest(self, at: np.ndarray, win: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(start, words)`` of the verbatim matches: runs of places that successive
        suffixes of one item have one after the other. Places parted by a gap share no
        match, so they are taken in parts of about ``PART`` places and suffixes."""
        counts = self.heads[win + 1] - self.heads[win]
        gaps = np.flatnonzero(np.diff(at) > 1) + 1
        part = np.cumsum(counts)[gaps - 1] // PART
        cuts = [0, *gaps[np.flatnonzero(np.diff(part)) + 1].tolist(), len(at)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            n, w = counts[lo:hi], win[lo:hi]
            base = np.repeat(self.heads[w] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            suffix = self.suffixes[base + np.arange(int(n.sum()))]
            place, size = np.repeat(at[lo:hi], n), np.repeat(self.size[w], n)
            order = np.lexsort((place, place - suffix))
            place, diagonal, size = place[order], (place - suffix)[order], size[order]
            new = np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            yield place[first], place[last] - place[first] + size[last]


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> tuple[int, Callable[[int], Tests]]:
    """The number of blocks of about ``block_bytes`` of text, and what gathers one."""
    src = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(count))

    def gather(k: int) -> Tests:
        rows = (src.where(block == k) if count > 1 else src).collect()
        return Tests([(r.item, r.text.encode()) for r in rows], window)

    return count, gather


def _shards(texts: list[bytes | None], vocab: dict[bytes, int], shard: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, numbered words, start of each row)``; a zero ends each row."""
    parts, starts, at, first = [], [], 0, 0
    for k, text in enumerate(texts):
        w = words(text)
        parts.append(np.fromiter(map(vocab.get, w, repeat(0)), np.int32, len(w)))
        parts.append(np.zeros(1, np.int32))
        starts.append(at)
        at += len(w) + 1
        if at >= shard:
            yield first, np.concatenate(parts), np.array([*starts, at])
            parts, starts, at, first = [], [], 0, k + 1
    if starts:
        yield first, np.concatenate(parts), np.array([*starts, at])


def _rows(tests: Tests, texts: list[bytes | None], shard: int) -> Iterator[tuple[int, list[tuple[int, int]], set[str], int]]:
    """``(n_words, marked (first, end) runs of words, items, longest)`` of each text."""
    for _, nums, starts in _shards(texts, tests.vocab, shard):
        at, win = tests.places(nums)
        sizes = np.diff(starts) - 1
        n = len(sizes)
        if not len(at):
            yield from ((int(s), [], set(), 0) for s in sizes)
            continue
        edge = np.zeros(len(nums) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + tests.size[win], -1)
        inside = np.cumsum(edge) > 0
        first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        end = np.flatnonzero(~inside & np.concatenate(([False], inside[:-1])))
        row_of_run = np.searchsorted(starts, first, "right") - 1
        runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for r, s, e in zip(row_of_run.tolist(), first.tolist(), end.tolist()):
            runs[r].append((s - int(starts[r]), e - int(starts[r])))
        row = np.searchsorted(starts, at, "right") - 1
        longest = np.zeros(n, np.int64)
        for begin, length in tests.longest(at, win):
            np.maximum.at(longest, np.searchsorted(starts, begin, "right") - 1, length)
        items: list[set[str]] = [set() for _ in range(n)]
        for code in np.unique(row * len(tests.windows) + win).tolist():
            for k in tests.owner[code % len(tests.windows)]:
                items[code // len(tests.windows)] |= tests.items[k]
        yield from zip(sizes.tolist(), runs, items, longest.tolist())


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, hits array<struct<first:long,end:long>>, items array<string>"
_HITS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _batch(ids: pa.Array, rows: list[tuple[int, list[tuple[int, int]], set[str], int]]) -> pa.RecordBatch:
    """A batch of ``SCHEMA``."""
    listed = [sorted(i) for _, _, i, _ in rows]
    columns = [
        ids,
        pa.array([n for n, *_ in rows], pa.int64()),
        pa.array([sum(e - s for s, e in h) for _, h, *_ in rows], pa.int64()),
        pa.array(list(map(len, listed)), pa.int64()),
        pa.array([sha256(",".join(i).encode()).hexdigest() for i in listed], pa.string()),
        pa.array([bool(h) for _, h, *_ in rows], pa.bool_()),
        pa.array([m for *_, m in rows], pa.int64()),
        pa.array([[{"first": s, "end": e} for s, e in h] for _, h, *_ in rows], _HITS),
        pa.array(listed, pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in SCHEMA.split(", ")])


def contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shard: int = SHARD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: counts, digest of the items, the marked runs of
    words (``hits``) and the longest verbatim match in words."""
    spark = docs.sparkSession
    count, gather = _blocks(bench, item_col, item_text_col, window, block_bytes)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def passed(k: int, only_hits: bool) -> tuple[DataFrame, Broadcast]:
        tests = spark.sparkContext.broadcast(gather(k))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    out = _batch(batch.column(0), list(_rows(tests.value, as_bytes(batch.column(1)), shard)))
                    if only_hits:
                        out = out.append_column("h1", batch.column(2)).append_column("h2", batch.column(3)).filter(out.column("contaminated"))
                    yield out

        if not only_hits:
            return src.mapInArrow(run, SCHEMA), tests
        keyed = src.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
        return keyed.mapInArrow(run, SCHEMA + ", h1 long, h2 long"), tests

    if count == 1:
        return passed(0, False)[0]
    found = []
    for k in range(count):
        part, tests = passed(k, True)
        found.append(materialize(part.select(F.col("doc_id").alias("id"), "h1", "h2", "longest_match", "hits", "items").distinct(), "contaminated"))
        tests.destroy()
    merged = reduce(DataFrame.unionByName, found).groupBy("id", "h1", "h2").agg(F.max("longest_match").alias("most"), F.flatten(F.collect_list("hits")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("named"))
    same = src.withColumns({"g1": F.xxhash64("text"), "g2": F.xxhash64(F.lit(1), "text")})
    met = same.join(merged.withColumnRenamed("id", "found"), F.col("id").eqNullSafe(F.col("found")) & (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")), "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, most, runs, named = as_bytes(batch.column(1)), *(batch.column(c).to_pylist() for c in (2, 3, 4))
            rows = [(len(words(t)), _union([(x["first"], x["end"]) for x in r or ()]), set(i or ()), m or 0) for t, m, r, i in zip(texts, most, runs, named, strict=True)]
            yield _batch(batch.column(0), rows)

    return met.select("id", "text", "most", "runs", "named").mapInArrow(merge, SCHEMA)


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_contaminated(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shard: int = SHARD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; of a benchmark in
    several blocks each removes its own, one after the other."""
    spark = docs.sparkSession
    count, gather = _blocks(bench, item_col, item_text_col, window, block_bytes)
    probe, width = output_name(docs.columns, "probe"), len(docs.columns)
    # a text that is a string already does not travel twice
    plain = dict(docs.dtypes).get(text_col) == "string"
    where = docs.columns.index(text_col) if plain else width

    def without(left: DataFrame, tests: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, where, SLICE)):
                clean = [not h for _, h, *_ in _rows(tests.value, as_bytes(batch.column(where)), shard)]
                yield pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width]).filter(pa.array(clean, pa.bool_()))

        return (left if plain else left.withColumn(probe, F.col(text_col).cast("string"))).mapInArrow(run, docs.schema)

    left, old = docs, None
    for k in range(count):
        tests = spark.sparkContext.broadcast(gather(k))
        left = without(left, tests)
        if count > 1:
            left = materialize(left, "clean")
            tests.destroy()
            if old is not None:
                discard(spark, old)
            old = left.scratch
    return left
