"""License scan with ordered signature rules.

Rules are hand-written patterns over the words of a text (lower case, one space
between words), most specific first: passages that tell license texts apart
(``license_texts``), and names and identifiers, of which families with versions are
written once and spelled out from their parameters. A rule names a keyword; one Aho-Corasick pass over the normalised text finds the
keywords that occur, and only their rules run. Matches of all rules are then
resolved in rule order: a match that lies inside a match of higher priority is
suppressed, overlaps that do not contain each other both stay.

The base phrases (``BASE``) are rules too, of the lowest priority, whose places
are always counted: suppression takes nothing from the base columns.

Defined results: a null text is an empty one (no words, null places, empty
labels, score 0); every row gives one row, repeated ids included; other columns
are not read. Texts are scanned whole; a match never spans more than its
pattern's bounded number of words, so long texts cost in proportion.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import as_bytes
from tallymill.llm.license_texts import TEXTS

#: The phrases of the base columns and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A))
_NORMAL = bytes.maketrans(bytes(range(0x41, 0x5B)) + _SEPARATORS, bytes(range(0x61, 0x7B)) + b" " * len(_SEPARATORS))


class Rule(NamedTuple):
    """``pattern`` matches at a word's start and ends at a word's end."""

    label: str
    keyword: str
    pattern: re.Pattern
    weight: float


def _rule(label: str, keyword: str, pattern: str, weight: float) -> Rule:
    return Rule(label, keyword, re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])"), weight)


def _version(v: str) -> str:
    """'2.0' as words: ``2 0``; a trailing zero may be missing,
    unless another part follows (2 is not the start of 2.1)."""
    parts = v.split(".")
    return " ".join(parts[:-1]) + r"(?: 0)?(?! \d)" if len(parts) > 1 and parts[-1] == "0" else " ".join(parts)


def rules() -> list[Rule]:
    """All rules in order of priority."""
    out: list[Rule] = []
    add = lambda *a: out.append(_rule(*a))

    # 1. identifiers in file headers: exact, hence first
    families = {
        "gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "apache": ("1.0", "1.1", "2.0"), "mpl": ("1.0", "1.1", "2.0"),
        "epl": ("1.0", "2.0"), "eupl": ("1.0", "1.1", "1.2"), "cddl": ("1.0", "1.1"), "osl": ("1.0", "2.0", "2.1", "3.0"), "afl": ("1.1", "1.2", "2.0", "2.1", "3.0"),
        "gfdl": ("1.1", "1.2", "1.3"), "artistic": ("1.0", "2.0"), "cpl": ("1.0",), "ofl": ("1.0", "1.1"), "bsl": ("1.0",), "lppl": ("1.0", "1.1", "1.2", "1.3a", "1.3c"),
        "zpl": ("1.1", "2.0", "2.1"), "php": ("3.0", "3.01"), "ecl": ("1.0", "2.0"), "upl": ("1.0",), "apsl": ("1.0", "1.1", "1.2", "2.0"), "cecill": ("1.0", "1.1", "2.0", "2.1"),
    }
    suffixes = {"gpl", "lgpl", "agpl", "gfdl"}
    for name, versions in families.items():
        for v in versions:
            if name in suffixes:
                add(f"{name}-{v}-or-later", "spdx", rf"spdx license identifier {name} {_version(v)} or later", 1.0)
                add(f"{name}-{v}-only", "spdx", rf"spdx license identifier {name} {_version(v)} only", 1.0)
            add(f"{name}-{v}", "spdx", rf"spdx license identifier {name} {_version(v)}", 1.0)
    for name in ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "cc0 1 0", "postgresql", "x11", "ntp", "curl", "ncsa", "vim", "ruby", "icu", "hpnd", "beerware"):
        add(name.split(" ")[0], "spdx", rf"spdx license identifier {name}", 1.0)
    for n in (1, 2, 3, 4):
        add(f"bsd-{n}-clause", "spdx", rf"spdx license identifier bsd {n} clause(?: \w+)?", 1.0)

    # 2. the long names with a version, "or later" before the bare version
    long = {
        "agpl": "(?:gnu )?affero general public license", "lgpl": "(?:gnu )?(?:lesser|library) general public license", "gpl": "(?:gnu )?general public license",
        "gfdl": "(?:gnu )?free documentation license", "apache": "apache(?: software)? license", "mpl": "mozilla public license", "epl": "eclipse public license",
        "eupl": "european union public licen[cs]e", "cddl": "common development and distribution license", "osl": "open software license", "afl": "academic free license",
        "artistic": "artistic license", "cpl": "common public license", "ofl": "(?:sil )?open font license", "bsl": "boost software license", "lppl": "latex project public license",
        "zpl": "zope public license", "php": "php license", "ecl": "educational community license", "upl": "universal permissive license", "apsl": "apple public source license", "cecill": "cecill(?: free software)? license(?: agreement)?",
    }
    key = {"ofl": "font", "gfdl": "documentation", "afl": "academic", "cecill": "cecill", "eupl": "european", "cddl": "distribution"}
    for name, phrase in long.items():
        word = key.get(name, "license")
        for v in families[name]:
            said = rf"(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?{_version(v)}"
            if name in suffixes:
                add(f"{name}-{v}-or-later", word, rf"{phrase}{said}(?: of the license)? or (?:at your option )?(?:any )?later(?: version)?", 0.98)
            add(f"{name}-{v}", word, rf"{phrase}{said}", 0.97)
    # 3. short names with a version
    for name in ("gpl", "lgpl", "agpl", "mpl", "epl", "eupl", "cddl", "osl", "afl", "gfdl", "ofl", "lppl"):
        for v in families[name]:
            if name in suffixes:
                add(f"{name}-{v}-or-later", name, rf"(?:gnu )?{name} ?v?(?:ersion )?{_version(v)} or (?:any )?later", 0.93)
            add(f"{name}-{v}", name, rf"(?:gnu )?{name} (?:version )?v?{_version(v)}", 0.9)
    # 4. Creative Commons
    kinds = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
    spelled = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
    for kind in sorted(kinds, key=len, reverse=True):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            label = f"cc-{kind.replace(' ', '-')}-{v}"
            add(label, "cc", rf"cc {kind} {' '.join(v.split('.'))}", 0.97)
            add(label, "creative", rf"creative commons {' '.join(spelled[k] for k in kind.split(' '))} {' '.join(v.split('.'))}", 0.97)
        add(f"cc-{kind.replace(' ', '-')}", "cc", rf"cc {kind}", 0.85)
    add("cc0-1.0", "cc0", r"cc0(?: 1 0)?", 0.95)
    # 5. passages of license texts
    for entry in TEXTS:
        add(*entry)
    # 6. long names without a version, then the base phrases
    for name, phrase in long.items():
        add(name, key.get(name, "license"), phrase, 0.8)
    for phrase, label in BASE:
        add(label, "license", phrase, 0.8)
    return out


class Scanner:
    """Rules with the automaton of their keywords; one a process."""

    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.gate = ahocorasick.Automaton()
        words = {r.keyword for r in self.rules}
        for w in words:
            self.gate.add_word(w, w)
        self.gate.make_automaton()
        self.by_word = {w: [k for k, r in enumerate(self.rules) if r.keyword == w] for w in words}

    def detections(self, normal: bytes) -> list[tuple[int, int, str, float]]:
        """``(start, end, label, weight)`` in bytes of the normalised text, after suppression."""
        # Latin-1 gives the automaton one character a byte
        present = {w for _, w in self.gate.iter(normal.decode("latin-1"))}
        active = sorted(k for w in present for k in self.by_word[w])
        taken: list[tuple[int, int, int]] = []
        for k in active:
            taken += [(m.start(), m.end(), k) for m in self.rules[k].pattern.finditer(normal)]
        return self.resolve(taken)

    def resolve(self, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Drop what lies inside a kept match of higher priority.

        Goes by start, longest first: a match inside another is met while the
        other is open. Of matches on the same span the higher rule stays; a
        longer match of lower priority does not suppress a higher one in it.
        """
        taken.sort(key=lambda t: (t[0], -t[1], t[2]))
        kept, open_ = [], []
        for s, e, k in taken:
            open_ = [o for o in open_ if o[1] > s]
            if any(o[1] >= e and o[2] <= k for o in open_):
                continue
            open_.append((s, e, k))
            kept.append((s, e, self.rules[k].label, self.rules[k].weight))
        return kept

    def scan(self, text: bytes | None) -> tuple:
        """``(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``."""
        normal = b" ".join((text or b"").translate(_NORMAL).split())
        n_words = normal.count(b" ") + 1 if normal else 0
        found = self.detections(normal)
        places, base = [], set()
        if b"license" in normal:
            for phrase, label in BASE:
                for m in re.finditer(rb"(?<![^ ])(?=" + phrase.encode() + rb"(?![^ ]))", normal):
                    places.append(m.start())
                    base.add(label)
        starts: list[int] = []
        if places or found:
            starts = [m.start() for m in re.finditer(rb"(?<![^ ])[^ ]", normal)]
        word = lambda at: bisect_right(starts, at) - 1
        spans = [(word(s), word(e - 1) + 1, label, weight) for s, e, label, weight in found]
        labels = base | {s[2] for s in spans}
        miss = 1.0
        for weight in {(s[2], s[3]) for s in spans}:
            miss *= 1.0 - weight[1]
        score = max(1.0 - miss, 0.8 if base else 0.0)
        return (
            n_words, len(places), word(min(places)) if places else None, word(max(places)) if places else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score), spans,
        )


_SCANNER: list[Scanner] = []

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:long,end:long,label:string,weight:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; ``detections`` holds the kept matches in words."""
    spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scan = _SCANNER[0].scan
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*map(scan, as_bytes(batch.column(1)))))
            listed = [[{"first": a, "end": b, "label": c, "weight": d} for a, b, c, d in r] for r in rows[7]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip([*rows[:7], listed], kinds))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
