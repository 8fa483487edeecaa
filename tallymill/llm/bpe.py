"""Byte-level BPE encoding and decoding by speculate and verify.

A word (a piece of the pre-tokenizer) is first cut greedily into the longest
tokens of the vocabulary. A cut is the true BPE result exactly when each token
is what merging makes of its own bytes and each adjacent pair is compatible,
that is, no merge across the pair's border would have come before the merges
that made the two tokens. All new words of a batch are cut, checked and repaired
together, by array operations; only words with a failing pair are merged
exactly, one merge of each of them at a time. A word of over ``KEEP_BYTES`` is
cut and merged alone. Results are kept per word, so frequent words are cut once
a process.

Defined results: a null text is an empty one and has no tokens; every row gives
one row, repeated ids included; other columns are not read. The special token's
string in a text becomes that token, as the file says. The vocabulary's file is
a parameter and its size (a few MB) is fixed, so it is broadcast.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import slices

#: Words that are merged together.
TOGETHER = 4096
#: Bytes of texts that are cut into words at once.
SLICE = 1 << 20
#: Fixed value: the pre-tokenizer's pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = np.iinfo(np.int64).max
#: Bytes and the end of a word.
_STRIDE = 257


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Vocabulary, merges and the caches of one process."""

    #: Words kept in the cache; beyond them those of the texts at hand stay (bounds the memory).
    KEEP = 100_000
    #: Longer words are not kept.
    KEEP_BYTES = 64

    def __init__(self, spec: str):
        import regex

        file = json.loads(spec)
        letters = _byte_letters()
        raw = lambda s: bytes(map(letters.__getitem__, s))
        model = file["model"]
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.id_of = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.text_of = list(map(str, range(size)))
        self.longest = max(map(len, self.id_of))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        #: The merge that makes a token: its order and halves; -1 for single bytes.
        self.made = np.full(size, -1, np.int64)
        self.half = np.full((2, size), -1, np.int64)
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.id_of[raw(left)], self.id_of[raw(right)]
            t = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = (k, t)
            if self.made[t] < 0:
                self.made[t], self.half[0, t], self.half[1, t] = k, a, b
        code = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(code)
        self._size, self._code = size, code[order]
        self._order = np.array([k for k, _ in self.rank.values()], np.int64)[order]
        self._result = np.array([t for _, t in self.rank.values()], np.int64)[order]
        self._byte = np.array([self.id_of.get(bytes([b]), -1) for b in range(256)], np.int64)
        # prefixes of tokens, by length and then by bytes: the k-th edge from a prefix to one longer by a byte leads to the prefix k + 1
        prefixes = sorted({b[:k] for b in self.id_of for k in range(len(b) + 1)}, key=lambda p: (len(p), p))
        number = {p: k for k, p in enumerate(prefixes)}
        self._edges = np.array([number[p[:-1]] * _STRIDE + p[-1] for p in prefixes[1:]], np.int64)
        self._token = np.array([self.id_of.get(p, -1) for p in prefixes], np.int64)
        self.sound = self._sound()
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.cache: dict[str, tuple[int, ...]] = {}

    def _merges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the merge of each pair, or a number above all, and the token it makes; -1 has no merge."""
        want = np.where(b < 0, -1, a * self._size + b)
        at = np.minimum(np.searchsorted(self._code, want), len(self._code) - 1)
        met = self._code[at] == want
        return np.where(met, self._order[at], _NEVER), np.where(met, self._result[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of a and b together leaves them apart.

        Goes back in time: of the two border tokens, the one made later is
        taken apart; at each step the border pair must not have a merge that
        comes before the next event, the one last undone. Ties, as in runs of
        one letter, are resolved from the left: an equal merge that reaches
        over the border wins only if it starts further left than the event.
        ``own`` limits the look to merges before that order (for a token's own
        halves).
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        # until: border merges of a lower order would have happened; on a tie the left one goes first
        until = np.full(len(a), _NEVER, np.int64) if own is None else own * 2
        while len(live):
            x, y = a[live], b[live]
            order, _ = self._merges(x, y)
            bad = (order != _NEVER) & (np.minimum(order, _NEVER // 4) * 2 + 1 <= until[live])
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            left_later = self.made[x] > self.made[y]
            done = (self.made[x] < 0) & (self.made[y] < 0)
            last = np.maximum(self.made[x], self.made[y])
            # an event left of the border (undone in x) precedes an equal border merge; one right of it does not
            until[live] = np.where(left_later, last * 2, last * 2 + 1)
            a[live] = np.where(left_later, self.half[1, x], x)
            b[live] = np.where(left_later, y, self.half[0, y])
            live = live[~done]
        return ok

    def _sound(self) -> np.ndarray:
        """Tokens that merging makes of their own bytes."""
        made = np.flatnonzero(self.made >= 0)
        good = np.zeros(len(self.made), bool)
        good[[i for b, i in self.id_of.items() if len(b) == 1]] = True
        apart = self.compatible(self.half[0, made], self.half[1, made], self.made[made])
        for t, ok in sorted(zip(made.tolist(), apart.tolist()), key=lambda p: self.made[p[0]]):
            good[t] = ok and good[self.half[0, t]] and good[self.half[1, t]]
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy cut into the longest tokens from the left."""
        out, at, ids, n = [], 0, self.id_of, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                t = ids.get(word[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy cuts of all words: their tokens one after another, and the word of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(sizes) - 1
        data = np.zeros(int(sizes.sum()), np.int64)
        inside = np.ones(len(data), bool)
        data[end], inside[end] = _STRIDE - 1, False
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        found = np.full(len(data), -2, np.int64)
        # a word is at the token that begins at ``at``; its bytes before ``pos`` are the prefix ``node``
        at = end - sizes + 1
        at, end = at[at < end], end[at < end]
        pos, upto, node, best = at.copy(), at + 1, np.zeros_like(at), np.full_like(at, -1)
        while len(at):
            want = node * _STRIDE + data[pos]
            edge = np.minimum(np.searchsorted(self._edges, want), len(self._edges) - 1)
            hit = self._edges[edge] == want
            node, pos = np.where(hit, edge + 1, 0), pos + hit
            token = self._token[node]
            longer = hit & (token >= 0)
            best, upto = np.where(longer, token, best), np.where(longer, pos, upto)
            miss = np.flatnonzero(~hit)
            if len(miss):
                found[at[miss]] = best[miss]
                at[miss] = pos[miss] = upto[miss]
                best[miss], upto[miss] = -1, at[miss] + 1
                live = at < end
                if not live.all():
                    at, end, pos, upto, node, best = (x[live] for x in (at, end, pos, upto, node, best))
        if (found == -1).any():
            raise ValueError("the vocabulary lacks a byte")
        cut = np.flatnonzero(found >= 0)
        return found[cut], np.repeat(np.arange(len(words)), sizes)[cut]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the earliest merge first, the leftmost of equals."""
        n = len(word)
        token = [self.id_of[word[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        rank = self.rank
        heap = [(*rank[p], i) for i, p in enumerate(zip(token, token[1:])) if p in rank]
        heap = [(k, i, t) for k, t, i in heap]
        heapq.heapify(heap)
        while heap:
            k, i, t = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or rank.get((token[i], token[j])) != (k, t):
                continue
            token[i], alive[j], after[i] = t, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if hit := rank.get((t, token[after[i]])):
                    heapq.heappush(heap, (hit[0], i, hit[1]))
            if before[i] >= 0 and (hit := rank.get((token[before[i]], t))):
                heapq.heappush(heap, (hit[0], before[i], hit[1]))
        return [token[i] for i in range(n) if alive[i]]

    def merge_all(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """The place of each word and what ``merge`` makes of it; words of like length share an array."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for s in range(0, len(order), TOGETHER):
            part = order[s : s + TOGETHER]
            yield from zip(part.tolist(), self._merged(b"".join(map(words.__getitem__, part)), sizes[part]))

    def _merged(self, data: bytes, sizes: np.ndarray) -> Iterator[tuple[int, ...]]:
        """Each round makes the next merge of every word."""
        n, width = len(sizes), int(sizes.max())
        token = np.full((n, width + 1), -1, np.int64)
        token[np.arange(width + 1) < sizes[:, None]] = self._byte[np.frombuffer(data, np.uint8)]
        token = token.ravel()
        cells = np.arange(len(token))
        after, before = cells + 1, cells - 1
        order, made = self._merges(token, np.append(token[1:], -1))
        table, rows = order.reshape(n, -1), np.arange(n)
        while len(rows):
            at = table[rows].argmin(axis=1) + rows * (width + 1)
            open_ = order[at] != _NEVER
            rows, at = rows[open_], at[open_]
            gone = after[at]
            right = after[gone]
            token[at], token[gone], order[gone] = made[at], -1, _NEVER
            after[at], before[right] = right, at
            order[at], made[at] = self._merges(token[at], token[right])
            at = at[at > rows * (width + 1)]
            left = before[at]
            order[left], made[left] = self._merges(token[left], token[at])
        kept = (token >= 0).reshape(n, -1).sum(axis=1).cumsum().tolist()
        ids = tuple(token[token >= 0].tolist())
        return (ids[s:e] for s, e in zip([0, *kept], kept))

    def learn(self, new: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of words that are not in the cache: speculate, verify, repair."""
        new = sorted(new, key=len)
        raw = list(map(str.encode, new))
        n = bisect(new, self.KEEP_BYTES, key=len)
        flat, word = self.propose_all(raw[:n])
        if n < len(raw):
            cuts = list(map(self.propose, raw[n:]))
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(cuts), np.int64)])
            word = np.concatenate([word, np.repeat(np.arange(n, len(raw)), list(map(len, cuts)))])
        failed = np.zeros(len(raw), bool)
        failed[word[~self.sound[flat]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inner] * self._size + flat[inner + 1], return_inverse=True)
        apart = self.compatible(pairs // self._size, pairs % self._size)
        failed[word[inner[~apart[back]]]] = True
        self.repaired = int(failed.sum())
        ends, ids = np.bincount(word, minlength=len(raw)).cumsum().tolist(), tuple(flat.tolist())
        out = [ids[s:e] for s, e in zip([0, *ends], ends)]
        bad = np.flatnonzero(failed).tolist()
        short = [k for k in bad if k < n]
        for k, tokens in self.merge_all([raw[k] for k in short]):
            out[short[k]] = tokens
        for k in bad[len(short) :]:
            out[k] = tuple(self.merge(raw[k]))
        return dict(zip(new, out))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text."""
        cut = [self.cut(t) if t else [] for t in texts]
        pieces = [[p if p in self.special else self.words(p) for p in parts if p] for parts in cut]
        seen: set[str] = set()
        for parts in pieces:
            for p in parts:
                if type(p) is list:
                    seen.update(p)
        if len(self.cache) > self.KEEP:
            self.cache = {w: self.cache[w] for w in seen if w in self.cache}
        fresh = self.learn(w for w in seen if w not in self.cache)
        self.cache.update((w, t) for w, t in fresh.items() if len(w) <= self.KEEP_BYTES)
        look = {w: t for w, t in fresh.items() if len(w) > self.KEEP_BYTES}
        find = (lambda w: self.cache.get(w) or look[w]) if look else self.cache.__getitem__
        for parts in pieces:
            if len(parts) == 1 and type(parts[0]) is list:
                yield list(chain.from_iterable(map(find, parts[0])))
            else:
                yield list(chain.from_iterable([self.special[p]] if type(p) is str else chain.from_iterable(map(find, p)) for p in parts))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(spec: str) -> Codec:
    """One codec a process and vocabulary."""
    key = hash(spec)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def _with_tokens(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[c.strip().split(" ")[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE):  # bounds the words held at once
                rows = [row(codec, ids) for ids in codec.encode_batch(part.column(1).to_pylist())]
                columns = [part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: token ids and the text decoded from them."""
    return _with_tokens(docs, tokenizer_file, id_col, text_col, "doc_id long, ids array<int>, decoded string", lambda c, ids: (ids, c.decode(ids)))


def encode_corpus(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)``: the training corpus, with the
    digest of the text that its ids decode to."""
    row = lambda c, ids: (len(ids), ids, sha256(c.decode(ids).encode()).hexdigest())
    return _with_tokens(docs, tokenizer_file, id_col, text_col, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", row)


def encode_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: the digests are taken
    where the tokens are made, so the tokens themselves need not travel."""

    def row(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join(map(codec.text_of.__getitem__, ids)).encode()
        return len(ids), sha256(listed).hexdigest(), sha256(codec.decode(ids).encode()).hexdigest()

    return _with_tokens(docs, tokenizer_file, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
