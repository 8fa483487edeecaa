import random
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

from tallymill.llm import bpe
from tallymill.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def codec():
    with open(tokenizer_file(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def test_every_token_is_sound_or_repaired(codec):
    for b, i in codec.id_of.items():
        assert codec.sound[i] <= (codec.merge(b) == [i])


def test_words_equal_the_library(codec, library):
    rng = random.Random(1)
    kinds = ["ab", "aaa", "thea ", "éèñ", "0123", "!.-", "漢字", "😀", "\n\t  ", "'s"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * k for k in range(200)] + [" " * k for k in range(90)] + ["<|endoftext|>a <|endoftext|><|endoftext|>", "<|endoftext", "é" * 5000, "ab" * 30000]
    got = list(codec.encode_batch(texts))
    assert codec.repaired > 0
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert ids == want.ids
        assert codec.decode(ids) == text


def test_broken_bytes_decode_as_the_library(codec, library):
    for ids in ([codec.id_of[b"\xc3"]], [codec.id_of[b"\xe6"], codec.id_of[b"a"]], [codec.id_of[b"\xf0"], codec.id_of[b"\x9f"]]):
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_operator(spark, library):
    rows = [(1, "Hello  world", "ids"), (2, None, None), (3, ""), (3, ""), (None, "x é"), (4, "w" * 20000)]
    df = spark.createDataFrame([(r[0], r[1], None) for r in rows], "doc_id long, text string, ids string")
    out = {(r.doc_id, r.decoded): list(r.ids) for r in bpe.encode(df, tokenizer_file()).collect()}
    for d, t, *_ in rows:
        assert out[d, t or ""] == library.encode(t or "", add_special_tokens=False).ids
    digests = {r.doc_id: r for r in bpe.encode_digests(df, tokenizer_file()).collect()}
    assert digests[2].n_tokens == 0 and digests[2].ids_sha256 == sha256(b"").hexdigest()
    ids = library.encode("Hello  world").ids
    assert digests[1].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert digests[1].decoded_sha256 == sha256(b"Hello  world").hexdigest()
    assert bpe.encode(df.limit(0), tokenizer_file()).count() == 0


def test_cache_is_bounded_and_texts_are_cut_by_bytes(spark, library, monkeypatch):
    """Beyond the bound the words of the texts at hand stay; a batch of long texts is not cut into words as a whole."""
    with open(tokenizer_file(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    assert codec.KEEP <= 100_000
    monkeypatch.setattr(codec, "KEEP", 300, raising=False)
    common = "the cat sat on the mat "
    for k in range(20):
        texts = [common + " ".join(f"w{k}x{j}{'abcdefgh'[j % 8]}q{j * 7919}" for j in range(200))]
        assert list(codec.encode_batch(texts)) == [library.encode(texts[0], add_special_tokens=False).ids]
        assert len(codec.cache) < 3000 and " cat" in codec.cache

    monkeypatch.setattr(bpe, "SLICE", 1000)
    rows = [(k, "ab cd " * 100 + str(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: list(r.ids) for r in bpe.encode(df, tokenizer_file()).collect()}
    assert out == {k: library.encode(t, add_special_tokens=False).ids for k, t in rows}


def test_rare_words_are_cut_and_merged_together(library, monkeypatch):
    """New words of a usual length are neither cut nor merged one at a time, and come out as merging each alone makes them."""
    with open(tokenizer_file(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    rng = random.Random(9)
    parts = ["eux", "ñ", "ción", "heit", "aaa", "ab", "ß", "the", "漢", "0", "--", "é", "tre", "x", "😀"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 16))) for _ in range(6000)] + ["a" * k for k in range(1, 65)]
    raw = [w.encode() for w in dict.fromkeys(words)]
    monkeypatch.setattr(bpe, "TOGETHER", 500)
    merged = dict(codec.merge_all(raw))
    assert [list(merged[k]) for k in range(len(raw))] == list(map(codec.merge, raw))
    flat, word = codec.propose_all(raw)
    greedy = [[] for _ in raw]
    for t, k in zip(flat.tolist(), word.tolist()):
        greedy[k].append(t)
    assert greedy == list(map(codec.propose, raw))

    alone = []
    for name in ("merge", "propose"):
        monkeypatch.setattr(codec, name, lambda b, f=getattr(codec, name): alone.append(b) or f(b))
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    got = list(codec.encode_batch(texts))
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert codec.repaired > 1000 and all(len(b.decode()) > codec.KEEP_BYTES for b in alone)
