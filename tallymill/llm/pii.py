"""Personal data: candidate spans scored by boosted trees, in DataFrame operations only.

Base kinds (``BASE``) are found by their patterns and kept when their rule holds.
High-recall generators (``EXTRA``) propose further spans, which may overlap each
other and the base ones; base matches that fail their rule are proposed too (a
card of 15 digits is one of them). Every proposal gets format features
(characters, digits, groups, cases, separators, spelled-out signs) and context
features (words and characters beside it). Each kind has gradient-boosted trees
of depth two, learnt on the driver and put into SQL expressions.

There are no labels for personal data in the corpus, so the trees learn from
``PLANTED`` short texts that SQL expressions make by rule: half of each kind holds
a value of the kind after a word that announces it or after plain words, half a
look-alike (order numbers, headings, prose across a full stop, long words, digits,
account numbers with wrong check digits, hashes and UUIDs). Values follow the
grammar of their form: check digits of accounts and cards, bank letters, prefixes
of known keys. Every other text has its plain words from the corpus, from pieces of
at most ``SNIPPETS`` documents without digits, taken by the hash of their id. A
proposal is right if it is exactly the planted span; all others, of other kinds
over the same characters too, are wrong. A threshold for each kind is calibrated on
held-out planted texts at precision ``PRECISION``; a kind without a right proposal
(failing addresses and phones) selects nothing. Selections are kept best score
first where they meet no kept span; base spans always stay.

Patterns use possessive quantifiers, which here match exactly what the plain
ones do, in linear time and without recursion on long runs. Offsets are code
points from sums over the gaps between matches, in two levels. Choosing among the
selected further spans of one text compares each with those kept, so its cost grows
with the square of their number in that text. No shuffle and no Python where texts
are read.

Defined results: a null text is an empty one without spans; every row gives one
row, repeated ids included; other columns are not read. No pattern bounds the
length of a span, but where the form itself has a fixed one.
"""

from __future__ import annotations

from functools import reduce
from itertools import count as count_up

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import discard, materialize

#: Short texts the trees learn from.
PLANTED = 12_000
#: Documents whose words stand around planted values.
SNIPPETS = 2_000
PRECISION = 0.95
#: No threshold lies below it, however few wrong proposals the held-out texts have.
LEAST_SCORE = 0.5
_LEVEL = 64
#: Kinds in their order; possessive forms of the given patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further generators: spelled-out addresses, local phone and identity numbers, accounts, devices and secrets.
EXTRA = {
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "device": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])(?<! dot |\[dot\] ?|\(dot\) ?)[A-Za-z0-9._%+-]++(?:(?: ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9_%+-]++)*+(?: ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]++(?:(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)[A-Za-z]{2,}+)++",
}
#: A plain test that is true wherever the pattern can match.
_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9]|[0-9][ -][0-9]", "phone": r"\+[0-9]", "account": "[A-Z]{2}[0-9]{2}", "device": "[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", "identity": "[0-9]-[0-9]{2}-", "local_phone": r"[0-9]{3}\)?[ .-][0-9]{3}", "secret": "[A-Za-z0-9_-]{16}", "spelled_email": r"at\]|at\)| at "}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
FEATURES = ("chars", "digits", "groups", "letters", "upper", "distinct", "first_group", "last_group", "seps", "spelled", "wide", "hint", "noise", "before", "after", "marks", "valid", "form", "prefix")
#: Words that announce a kind, and words that announce other numbers.
ANNOUNCE = {
    "account": "iban|account|bank|transfer|konto|compte|cuenta", "card": "card|visa|amex|credit|diners|karte|carte|tarjeta", "device": "mac|device|adapter|hardware|interface", "email": "mail|contact|write",
    "identity": "ssn|social|security|identity|taxpayer", "ip": "ip|host|server", "local_phone": "call|phone|tel|fax|mobile|contact|reach|telefon|telefono|telephone",
    "phone": "call|phone|tel|fax|mobile", "secret": "key|apikey|token|secret|password|passwd|pwd|auth|bearer|credential|passwort|contrasena", "spelled_email": "mail|email|contact|write|reach|address",
}
OTHER = "version|page|section|isbn|order|invoice|chapter|figure|table|part|ref|serial|file|build|score|sum|commit|uuid|guid|sha|hash|digest|checksum|revision|rechnung|facture|factura|seite"
#: How keys of known issuers begin; the form of a UUID.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "sk-", "sk_live_", "sk_test_", "pk_live_", "pk_test_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "npm_", "hf_")
_UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_TAIL = r"[^a-z]*(?:(?:is|on|to|number|no|nr|under|me)[^a-z]*)?$"


def _step(df: DataFrame, keep: list[str], made: dict[str, Column]) -> DataFrame:
    """Columns made once: a generated row keeps the optimizer from making them
    again wherever a later lambda uses them."""
    out = df.select(*keep, F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items())))).alias("made_"))
    return out.select(*keep, *(F.col(f"made_.{n}").alias(n) for n in made))


def _rule(kind: str, value: Column) -> Column:
    """Whether a match of a base kind holds."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), _luhn(digits) == 0).otherwise(False)


def _luhn(digits: Column) -> Column:
    """The sum of a card number modulo ten; zero where its check digit is right."""
    twice = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(twice, c.cast("int") + 1))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10


def _account_rest(value: Column) -> Column:
    """An account number modulo 97, its first four signs read last, letters as 10 to 35;
    one where its check digits are right."""
    signs = F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")
    turned = F.concat(F.substring(signs, F.lit(5), F.length(signs)), F.left(signs, F.lit(4)))

    add = lambda rest, c: F.when(c == "", rest).when(c >= "A", rest * 100 + F.ascii(c) - 55).otherwise(rest * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _features_of_form(kind: str, value: Column, digits: Column) -> dict[str, Column]:
    """Whether check digits are right, what the whole looks like, whether it begins as known keys do."""
    zero = F.lit(0)
    valid = {"account": F.when(_account_rest(value) == 1, 1).otherwise(0), "card": F.when(F.length(digits).between(12, 19), F.when(_luhn(digits) == 0, 1).otherwise(0)).otherwise(0)}
    form = F.when(value.rlike(_UUID), 1).when(value.rlike(r"\A[0-9_-]+\z"), 2).when(value.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"), 3).when(value.rlike(r"\A[A-Za-z_-]+\z"), 4).otherwise(0)
    secret = kind == "secret"
    return {"valid": valid.get(kind, zero), "form": form if secret else zero, "prefix": value.rlike(rf"\A(?:{'|'.join(KEY_PREFIXES)})").cast("int") if secret else zero}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found)``: of each row all proposals of all kinds, as structs of
    kind, start, end (code points), ``base`` (the rule of a base kind holds) and features."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = {**BASE, **EXTRA}
    none = F.array().cast("array<string>")
    df = _step(df, ["doc_id", "text"], {f"m_{k}": F.when(F.col("text").rlike(_GATE[k]), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in kinds.items()})
    matches = [f"m_{k}" for k in kinds]
    df = _step(df, ["doc_id", *matches], {f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none) for k, p in kinds.items()})
    gaps = [f"g_{k}" for k in kinds]
    # lengths of each gap with the match after it; sums of LEVEL of them; starts of those
    lens = {f"l_{k}": F.transform(F.arrays_zip(F.col(f"g_{k}").alias("g"), F.col(f"m_{k}").alias("m")), lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))) for k in kinds}
    df = _step(df, ["doc_id", *matches, *gaps], lens)
    total = lambda array: F.aggregate(array, F.lit(0), lambda a, b: a + b)
    upto = lambda column: F.sequence(F.lit(0), F.floor((F.size(column) - 1) / _LEVEL).cast("int"))
    level = lambda column: lambda c: total(F.slice(column, c * _LEVEL + 1, _LEVEL))
    sums = {f"s_{k}": F.when(F.size(f"l_{k}") > 0, F.transform(upto(f"l_{k}"), level(f"l_{k}"))).otherwise(F.array().cast("array<int>")) for k in kinds}
    lengths = [f"l_{k}" for k in kinds]
    df = _step(df, ["doc_id", *matches, *gaps, *lengths], sums)
    before_level = lambda column: lambda _, c: F.when(c > 0, total(F.slice(column, F.lit(1), F.greatest(c, F.lit(1))))).otherwise(0)
    heads = {f"h_{k}": F.transform(f"s_{k}", before_level(f"s_{k}")) for k in kinds}
    df = _step(df, ["doc_id", *matches, *gaps, *lengths], heads)

    def proposals(k: str) -> Column:
        def one(value: Column, i: Column) -> Column:
            inner = i % _LEVEL
            start = F.element_at(f"h_{k}", F.floor(i / _LEVEL).cast("int") + 1) + F.when(inner > 0, total(F.slice(f"l_{k}", i - inner + 1, F.greatest(inner, F.lit(1))))).otherwise(0)
            gap = F.element_at(f"g_{k}", i + 1)
            start = start + F.length(gap)
            before, after = F.right(gap, F.lit(24)), F.left(F.element_at(f"g_{k}", i + 2), F.lit(2))
            digits = F.regexp_replace(value, "[^0-9]+", "")
            groups = F.split(F.regexp_replace(value, r"\A[^0-9]+|[^0-9]+\z", ""), "[^0-9]+")
            side = lambda c, text: F.when(text.rlike(c.format(r"\s")), 1).when(text.rlike(c.format("[:=]")), 2).when(text.rlike(c.format("[A-Za-z]")), 3).when(text.rlike(c.format("[0-9]")), 4).when(F.length(text) == 0, 0).otherwise(5)
            made = {
                "chars": F.length(value), "digits": F.length(digits), "groups": F.size(groups), "letters": F.length(F.regexp_replace(value, "[^A-Za-z]+", "")),
                "upper": F.length(F.regexp_replace(value, "[^A-Z]+", "")), "distinct": F.size(F.array_distinct(F.split(F.lower(value), ""))),
                "spelled": F.size(F.split(value, r"[\[(](?:at|dot)[\])]| dot ")), "wide": F.size(F.split(value, r"[.] ")),
                "first_group": F.length(F.element_at(groups, 1)), "last_group": F.length(F.element_at(groups, -1)), "seps": F.length(F.regexp_replace(value, "[^ .()-]+", "")),
                "hint": before.rlike(rf"(?i)(?<![a-z])(?:{ANNOUNCE[k]}){_TAIL}").cast("int"), "noise": before.rlike(rf"(?i)(?<![a-z])(?:{OTHER}){_TAIL}").cast("int"), "before": side("{}\\z", before), "after": side("\\A{}", after),
                "marks": F.length(F.regexp_replace(value, "[A-Za-z0-9 .()-]+", "")), **_features_of_form(k, value, digits),
            }
            base = _rule(k, value) if k in BASE else F.lit(False)
            return F.struct(F.lit(k).alias("name"), start.alias("start"), (start + F.length(value)).alias("end"), base.alias("base"), F.array(*(made[f].cast("double") for f in FEATURES)).alias("x"))

        return F.transform(f"m_{k}", one)

    return _step(df, ["doc_id"], {"found": F.concat(*map(proposals, kinds))})


class Trees:
    """Boosted trees of depth two on the logistic loss."""

    ROUNDS, RATE, CUTS = 16, 0.5, 16

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base, self.trees = 0.0, []
        if not len(y) or not 0 < y.sum() < len(y):
            return
        self.base = float(np.log(y.sum() / (len(y) - y.sum())))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.CUTS + 1)[:-1])) for j in range(x.shape[1])]
        score = np.full(len(y), self.base)
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            j, t = self._cut(x, g, h, cuts)
            tree, step = [j, t], np.zeros(len(y))
            for part in (x[:, j] <= t, x[:, j] > t):
                k, u = self._cut(x[part], g[part], h[part], cuts)
                leaves = []
                for leaf in (x[:, k] <= u, x[:, k] > u):
                    at = part & leaf
                    leaves.append(float(self.RATE * g[at].sum() / (h[at].sum() + 1)))
                    step[at] = leaves[-1]
                tree.append((k, u, *leaves))
            score += step
            self.trees.append(tuple(tree))

    @staticmethod
    def _cut(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
        best = (-1.0, 0, 0.0)
        for j, c in enumerate(cuts):
            if len(x) and len(c):
                b = np.searchsorted(c, x[:, j])
                gl, hl = np.bincount(b, g, len(c) + 1).cumsum()[:-1], np.bincount(b, h, len(c) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), j, float(c[k]))
        return best[1:]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, t, *sides in self.trees:
            for part, (k, u, a, b) in zip((x[:, j] <= t, x[:, j] > t), sides):
                total += np.where(part, np.where(x[:, k] <= u, a, b), 0.0)
        return 1 / (1 + np.exp(-total))

    def column(self, x: Column) -> Column:
        """The score of a feature array as one SQL expression."""
        at = lambda j: F.element_at(x, j + 1)
        leaf = lambda k, u, a, b: F.when(at(k) <= u, F.lit(a)).otherwise(F.lit(b))
        parts = [F.when(at(j) <= t, leaf(*low)).otherwise(leaf(*high)) for j, t, low, high in self.trees]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(self.base))))


class Model:
    """For each kind its trees, with a threshold calibrated on held-out candidates."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: np.ndarray, held: np.ndarray, precision: float = PRECISION):
        self.trees, self.threshold = {}, {}
        for k in [*BASE, *EXTRA]:
            own = names == k
            self.trees[k] = Trees(x[own & ~held], y[own & ~held])
            # without wrong ones to learn from there is nothing to calibrate on either
            known = bool(self.trees[k].trees)
            self.threshold[k] = self._calibrate(self.trees[k].score(x[own & held]), y[own & held], precision) if known else 2.0

    @staticmethod
    def _calibrate(p: np.ndarray, y: np.ndarray, precision: float) -> float:
        """Lowest score, from ``LEAST_SCORE`` on, from which on the precision holds; above 1 if none."""
        order = np.argsort(-p, kind="stable")
        good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        last = np.append(p[order][1:] != p[order][:-1], True)[: len(p)]  # equal scores are taken together
        ok = np.flatnonzero((good >= precision) & last)
        return max(float(p[order][ok[-1]]), LEAST_SCORE) if len(ok) else 2.0

    def score(self, name: Column, x: Column) -> Column:
        """The score of a proposal of a kind."""
        known = [k for k in self.trees if self.trees[k].trees]
        return reduce(lambda rest, k: F.when(name == k, self.trees[k].column(x)).otherwise(rest), known, F.lit(0.0))


def snippets(docs: DataFrame, count: int = SNIPPETS, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Words of at most ``count`` documents, first by the hash of their id: from each a piece
    without digits and addresses, ending in a space. Bounded by the count times 60 characters."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.greatest(F.char_length(text) - 60, F.lit(1))).cast("int") + 1
    piece = F.regexp_extract(F.substring(text, at, F.lit(60)), r"(?s)\s([^0-9@]*[^0-9@\s])\s", 1)
    rows = docs.select(F.xxhash64(F.col(id_col), F.lit(2)).alias("h"), piece.alias("piece")).where("length(piece) > 10").orderBy("h", "piece").limit(count)
    return [r.piece + " " for r in rows.collect()]


#: Entries of ``made`` in ``planted``.
_FORMS = 9


def planted(spark: SparkSession, count: int = PLANTED, around: list[str] | None = None) -> DataFrame:
    """``(doc_id, text, name, start, end)``: short texts by rule; ``name`` is the kind of
    the one value that is planted, or null in a text with a look-alike. Every other text has
    pieces of ``around`` for its plain words, where there are any."""
    salts = count_up(1)
    mod = lambda c, n: F.pmod(F.xxhash64("id", F.lit(c)), F.lit(n))

    def pick(*values: Column | str) -> Column:
        """One of the values, by the hash of the id."""
        own = [v if isinstance(v, Column) else F.lit(v) for v in values]
        return F.element_at(F.array(*own), (mod(next(salts), len(own)) + 1).cast("int"))

    def digits(n: int) -> Column:
        # in parts, as a number has at most 18 digits
        return F.concat(*(F.lpad(mod(next(salts), 10**k).cast("string"), k, "0") for k in [9] * (n // 9) + [n % 9] * (n % 9 > 0)))

    def hexes(n: int) -> Column:
        return F.left(F.sha2(F.concat_ws("-", "id", F.lit(next(salts)).cast("string")), 256), F.lit(n))

    def mixed(n: int) -> Column:
        """Letters of both cases and digits."""
        return F.left(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("-", "id", F.lit(next(salts)).cast("string")), 512))), r"[+/=\s]", "7"), F.lit(n))

    def word(most: int = 9) -> Column:
        signs = hexes(16)
        letters = pick(*(F.translate(signs, "0123456789abcdef", to) for to in ("aeiourstnlaeidmh", "ecghuftbvzswrkin", "aeioupqyxjwdlmgc")))
        return F.substring(letters, F.lit(1), (mod(next(salts), most - 2) + 3).cast("int"))

    def accounts(right: bool) -> Column:
        """Country, check digits, bank letters, digits and further signs; in groups of four, or not."""
        forms = (("DE", 0, 18, 0), ("GB", 4, 14, 0), ("FR", 0, 10, 13), ("ES", 0, 20, 0), ("NL", 4, 10, 0), ("IT", 1, 22, 0))
        at = (mod(next(salts), len(forms)) + 1).cast("int")
        country, letters, number, last = (F.element_at(F.array(*map(F.lit, column)), at) for column in zip(*forms))
        tail = F.concat(F.left(F.translate(hexes(8), "0123456789abcdef", "ABCDEFGHIKLMNOPR"), letters), F.left(digits(22), number), F.left(F.upper(mixed(13)), last))
        check = 98 - _account_rest(F.concat(country, F.lit("00"), tail))
        # a look-alike has any other check digits
        check = check if right else (check + mod(next(salts), 90) + 1) % 97
        return F.regexp_replace(F.concat(country, F.lpad(check.cast("string"), 2, "0"), tail), pick("(.{4})(?=.)", "(.{40})"), F.lit("$1 "))

    def numbered(start: str, length: int, right: bool) -> Column:
        """Digits whose last one is the check digit, or another."""
        body = F.concat(F.lit(start), digits(length - len(start) - 1))
        check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
        return F.concat(body, (check if right else (check + mod(next(salts), 9) + 1) % 10).cast("string"))

    join = F.concat
    pairs = lambda sep: F.concat_ws(sep, *(hexes(2) for _ in range(6)))
    tld = lambda: pick("com", "org", "net", "de", "fr", "es")
    spelled = lambda at, dot: join(word(), pick("", join(F.lit(dot), word())) if dot != "." else F.lit(""), F.lit(at), word(), F.lit(dot), tld())
    spaced = lambda c: F.regexp_replace(c, "^(....)(......)(.....)$", "$1 $2 $3")
    phone = lambda: pick(join(F.lit("("), digits(3), F.lit(") "), digits(3), F.lit("-"), digits(4)), *(F.concat_ws(s, digits(3), digits(3), digits(4)) for s in "-. "))
    identity = lambda: F.concat_ws("-", digits(3), digits(2), digits(4))
    issued = lambda: pick(join(F.lit("AKIA"), F.upper(mixed(16))), join(F.lit("AIza"), mixed(35)), join(F.lit("sk-"), pick(mixed(20), mixed(48), mixed(80))), join(pick("sk_live_", "pk_live_", "sk_test_"), mixed(24)), join(pick("ghp_", "gho_", "hf_", "npm_"), mixed(36)), join(F.lit("glpat-"), mixed(20)), join(F.lit("xoxb-"), digits(11), F.lit("-"), digits(12), F.lit("-"), mixed(24)))
    named = lambda: join(pick("key-", "api-", "token_", "auth-"), pick(mixed(20), mixed(32), mixed(48), hexes(32)))
    uuid = lambda: F.concat_ws("-", hexes(8), hexes(4), hexes(4), hexes(4), hexes(12))
    hashed = lambda: pick(hexes(16), hexes(32), hexes(40), hexes(64))
    phrase = lambda: pick(join(word(), digits(1), word(), digits(1), word(), word(), digits(2), F.lit("moon")), join(F.initcap(word()), F.lit("_"), word(), digits(4), word(), F.lit("leaf4")), join(word(), F.lit("-"), digits(2), word(), F.lit("-"), word(), F.lit("river"), digits(1)))
    shout = lambda: F.upper(F.concat_ws(" ", *(F.left(join(word(), F.lit("xxxx")), F.lit(4)) for _ in range(4))))
    long = lambda: join(word(), word(), word(), word(), F.lit("heitenung"))
    prose = lambda: join(word(), F.lit(" at "), word(), F.lit(". "), F.initcap(word()), F.lit(" "), word())
    slugs = lambda s: F.concat_ws(s, word(), word(), word(), word(), word())
    #: Kind, a value of it, a look-alike; shares in tenths of values that are announced and of look-alikes after plain words.
    made = [
        ("identity", identity(), identity(), 8, 0),
        ("local_phone", phone(), phone(), 8, 0),
        ("account", accounts(True), pick(accounts(False), accounts(False), join(F.upper(hexes(2)), digits(2), F.lit(" "), shout()), join(F.lit("AB"), digits(2), F.lit(" "), shout())), 5, 5),
        ("device", pick(pairs(":"), pairs("-"), F.upper(pairs(":"))), pick(pairs(":"), pairs("-")), 8, 0),
        ("secret", pick(issued(), issued(), named(), mixed(40)), pick(long(), F.upper(long()), F.initcap(long()), join(long(), F.upper(word())), F.initcap(join(long(), long())), slugs("_"), slugs("-"), digits(17), digits(18), F.concat_ws("-", digits(4), digits(6), digits(6)), join(slugs("-"), F.lit("-"), digits(4))), 5, 5),
        ("secret", pick(hashed(), hashed(), phrase(), phrase()), pick(uuid(), uuid(), hashed(), hashed(), phrase()), 10, 5),
        ("spelled_email", pick(spelled("[at]", "[dot]"), spelled(" [at] ", " [dot] "), spelled(" at ", " dot "), spelled("(at)", "."), spelled(" (at) ", " (dot) ")), pick(prose(), prose(), join(word(), F.lit(" at "), word(), F.lit(". "), word()), join(word(), F.lit(" at "), word(), F.lit("."), F.initcap(word()))), 5, 5),
        ("card", pick(spaced(numbered("37", 15, True)), numbered("34", 15, True), numbered("37", 15, True), numbered("36", 14, True)), pick(digits(9), digits(11), digits(13), numbered("37", 15, False), spaced(numbered("34", 15, False)), numbered("36", 14, False), digits(20), F.concat_ws(" ", digits(3), digits(5), digits(4)), F.concat_ws("-", digits(4), digits(2), digits(2))), 8, 3),
        ("secret", issued(), slugs("-"), 3, 5),
    ]
    assert len(made) == _FORMS
    own = lambda: F.concat_ws(" ", word(), word(), F.lit(""))
    salt = count_up(-1000)
    pieces = spark.createDataFrame(list(enumerate(around or [])), "piece_ int, words_ string")
    parts = []
    for k, (kind, value, other, told_share, plain_share) in enumerate(made):
        plain = F.col("plain")
        announced = join(plain, pick(*ANNOUNCE[kind].split("|")), pick(" ", ": ", "=", " is ", " number ", " = ", ' = "'))
        noise = join(plain, pick(*OTHER.split("|")), pick(" ", ": ", " no ", " number ", " ", "="))
        after = join(pick(" ", ", ", ". ", "\n"), own()).alias("after")
        # the form alone does not tell an identity number, a phone or a device from others; a look-alike follows a word for other things
        halves = [(F.lit(kind), F.when(mod(next(salt), 10) < told_share, announced).otherwise(plain), value), (F.lit(None).cast("string"), F.when(mod(next(salt), 10) < plain_share, plain).otherwise(noise), other)]
        in_words, piece = mod(next(salt), 2) == 0, mod(next(salt), max(len(around or []), 1))
        for at, (name, before, shown) in enumerate(halves):
            ids = spark.range(k + at * len(made), count, 2 * len(made)).withColumn("piece_", F.when(in_words, piece).cast("int"))
            rows = ids.join(F.broadcast(pieces), "piece_", "left")
            # apart by a generated row, which keeps the generated code of each small
            parts.append(_step(rows, ["id"], {"plain": F.coalesce("words_", own()), "value": shown, "after": after}).select(F.col("id").alias("doc_id"), name.alias("name"), before.alias("before"), "value", "after"))
    rows, start = reduce(DataFrame.unionByName, parts), F.char_length("before")
    return rows.select("doc_id", F.concat("before", "value", "after").alias("text"), "name", start.alias("start"), (start + F.char_length("value")).alias("end"))


def train(spark: SparkSession, count: int = PLANTED, docs: DataFrame | None = None) -> Model:
    """Learns from the proposals in ``count`` planted texts, which have words of ``docs``
    around their values where it is given; every fifth text is held out."""
    around = None if docs is None else snippets(docs)
    texts = materialize(planted(spark, count, around), "planted")  # apart, so that each plan stays small
    planted_at = texts.where("name is not null").select("doc_id", "name", "start", "end").toArrow()
    told = set(zip(*(c.to_pylist() for c in planted_at.columns)))
    c = candidates(texts).select("doc_id", F.explode("found").alias("c")).where(~F.col("c.base"))
    # in columns: the driver never holds a row object for each proposal
    found = c.select("doc_id", "c.name", "c.start", "c.end", F.transform("c.x", lambda v: v.cast("double")).alias("x")).toArrow()
    discard(spark, texts.scratch)
    at = list(zip(*(c.to_pylist() for c in found.columns[:4])))
    order = np.array(sorted(range(len(at)), key=lambda k: at[k][:3]), np.int64)
    flat = found.column("x").combine_chunks()
    values = flat.flatten() if found.num_rows else []
    x = np.asarray(values, np.float64).reshape(len(at), len(FEATURES))[order]
    held = np.array([at[k][0] // (2 * _FORMS) % 5 == 0 for k in order], bool)
    right = np.array([at[k] in told for k in order], np.float64)
    return Model(x, right, np.array([at[k][1] for k in order]), held)


def select_free(df: DataFrame, keep: list[str]) -> DataFrame:
    """``free``: of the spans ``more`` those that meet no span of ``base`` and, best
    first, none that is kept already."""
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    alone = F.filter("more", lambda c: ~F.exists("base", lambda b: meet(b, c)))
    # the better score first, then the earlier start, the later end and the later name
    ranked = F.sort_array(F.transform(alone, lambda c: F.struct(c["score"].alias("score"), (-c["start"]).alias("back"), c["start"].alias("start"), c["end"].alias("end"), c["name"].alias("name"))), asc=False)
    df = _step(df, keep, {"ranked": ranked})
    free = F.aggregate("ranked", F.slice("ranked", 1, 0), lambda kept, c: F.when(F.exists(kept, lambda k: meet(k, c)), kept).otherwise(F.concat(kept, F.array(c))))
    return _step(df, keep, {"free": F.array_sort(F.transform(free, lambda c: F.struct(c["name"].alias("name"), c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score"))))})


def find_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redactions)``;
    ``redactions`` are the selected spans as structs of name, start, end and score."""
    df = candidates(docs, id_col, text_col)
    limit = F.create_map(*(F.lit(v) for k, t in model.threshold.items() for v in (k, float(t))))
    base = F.transform(F.filter("found", lambda c: c["base"]), lambda c: F.struct(c["name"].alias("name"), c["start"].alias("start"), c["end"].alias("end"), F.lit(1.0).alias("score")))
    scored = F.transform(F.filter("found", lambda c: ~c["base"]), lambda c: F.struct(c["name"].alias("name"), c["start"].alias("start"), c["end"].alias("end"), model.score(c["name"], c["x"]).alias("score")))
    df = _step(df, ["doc_id"], {"base": base, "scored": scored})
    df = _step(df, ["doc_id", "base"], {"more": F.filter("scored", lambda c: c["score"] >= F.element_at(limit, c["name"]))})
    df = select_free(df, ["doc_id", "base"])
    told = lambda arr: F.transform(arr, lambda c: F.concat_ws(":", c["name"], c["start"].cast("string"), c["end"].cast("string")))
    of = lambda arr, k: F.filter(arr, lambda c: c["name"] == k)
    ordered = F.concat(*(F.array_sort(F.concat(of("base", k), of("free", k))) for k in BASE), F.filter("free", lambda c: ~c["name"].isin(*BASE)))
    df = _step(df, ["doc_id", "base"], {"redactions": ordered})
    return df.select(
        "doc_id", *(F.size(of("base", k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(told("base"), ","), 256).alias("base_sha256"), F.array_join(told("redactions"), ",").alias("spans"), "redactions",
    )
