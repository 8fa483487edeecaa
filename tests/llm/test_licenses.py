import random
import re

from tallymill.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in hits}))


def test_base_equals_brute_force():
    rng = random.Random(2)
    parts = ["MIT", "mit", "license", "License", "apache", "general", "public", "é", "2.0", "\n", " ", "-", " ", "The", "licenseX", "\x7f"]
    scan = licenses.Scanner().scan
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        got = scan(text.encode())
        assert got[:5] == brute(text)
        assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))
        assert 0 <= got[6] <= 1


def test_rules():
    scanner = licenses.Scanner()
    assert len(scanner.rules) >= 300
    labels = lambda t: scanner.scan(t.encode())[5]
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == "gpl-3.0-or-later"
    assert labels("SPDX-License-Identifier: Apache-2.0") == "apache-2.0"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by-nc-4.0"
    assert labels("under the GNU Lesser General Public License, version 2.1 or later") == "gpl,lgpl-2.1-or-later"
    assert labels("Redistribution and use in source and binary forms, with or without modification") == "bsd-2-clause"
    assert labels("a license to thrill") == ""


def test_gate_loses_nothing():
    """The keyword of a rule occurs in all it matches: running every rule finds the same."""
    scanner = licenses.Scanner()
    rng = random.Random(4)
    words = "licensed under the mit license gnu affero lesser general public version 2 0 1 or later spdx identifier gpl bsd 3 clause creative commons attribution share alike 4 cc by sa".split()
    for _ in range(2000):
        text = " ".join(rng.choices(words, k=20)).encode()
        every = [(m.start(), m.end(), k) for k, r in enumerate(scanner.rules) for m in r.pattern.finditer(text)]
        assert scanner.detections(text) == scanner.resolve(every)


def test_operator_edges(spark):
    rows = [(1, "The MIT License", "x"), (1, "The MIT License", "x"), (2, None, None), (3, "", ""), (None, "mit license mit license", ""), (4, "word " * 30000 + "apache license", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    out = licenses.scan_licenses(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert (by[2].n_words, by[2].n_base, by[2].first_word, by[2].labels, by[2].score) == (0, 0, None, "", 0.0)
    assert (by[None].n_base, by[None].first_word, by[None].last_word) == (2, 0, 2)
    assert by[4].first_word == 30000 and by[4].base_labels == "apache"
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def _written(tree, rng):
    """A text that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "SUBPATTERN":
            out += _written(arg[3], rng)
        elif name == "BRANCH":
            out += _written(rng.choice(arg[1]), rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(_written(arg[2], rng) for _ in range(arg[0] if rng.random() < 0.6 else min(arg[1], arg[0] + 1)))
        elif name == "IN":
            out += chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "7" if "DIGIT" in str(arg[0]) else "a"
    return out


def test_the_gate_hides_no_match():
    """Texts written from each rule's own pattern hold its keyword and are found, by the rule or one above it."""
    import random
    from re import _parser

    rng = random.Random(5)
    scanner = licenses.Scanner()
    assert len(scanner.rules) > 300
    for rule in scanner.rules:
        for _ in range(20):
            text = _written(_parser.parse(rule.pattern.pattern.decode()), rng)
            assert rule.keyword in text, (rule.label, text)
            spans = scanner.scan(text.encode())[7]
            assert any(s == 0 for s, *_ in spans), (rule.label, text, spans)


def test_passages_of_texts():
    scan = licenses.Scanner().scan
    found = lambda t: set(scan(t.encode())[5].split(","))
    assert "mpl-2.0" in found("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.")
    assert "zlib" in found("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.")
    assert "unlicense" in found("This is free and unencumbered software released into the public domain.")
    assert "agpl-3.0" in found("all users interacting with it remotely through a computer network")
    assert found("the server side was public and the license plate was new") == {""}
