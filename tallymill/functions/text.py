"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slug(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, lower case. The JVM's functions have no normal forms."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())


def clean(c: Column) -> Column:
    """Without format characters, with single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Cf}", ""), r"\s+", " "))


def player_slug(name: Column, code: Column) -> Column:
    """Tokens in capitals are the surname and go first, then given names, then the team's code."""
    tokens = F.filter(F.split(name, r"\s+"), lambda t: t != "")
    is_caps = lambda t: (t == F.upper(t)) & (t != F.lower(t))
    surname, given = F.filter(tokens, is_caps), F.filter(tokens, lambda t: ~is_caps(t))
    return slug(F.array_join(F.concat(surname, given, F.array(code)), " "))


def match_span(text: Column, needle: str) -> Column:
    """First place of a needle as ``(start, end)``, ignoring case; null where absent."""
    # matched on the text as it is: lowering may change its length
    pattern = r"(?iu)\Q" + needle + r"\E"
    found = F.regexp_substr(text, F.lit(pattern))
    start = F.char_length(F.element_at(F.split(text, pattern, 2), 1))
    return F.when(found.isNotNull(), F.struct(start.cast("bigint").alias("start"), (start + F.char_length(found)).cast("bigint").alias("end")))


def term_span(text: Column, term: str) -> Column:
    """First place of a term that begins a word, as ``(start, end)`` with the end at the end
    of its last word, ignoring case; where the term is absent, its words may each be in the
    plural and any space may part them. Null where neither is found."""
    def first(pattern: str) -> Column:
        whole = r"(?iu)(?<![\p{L}\p{N}])(?:" + pattern + r")[\p{L}\p{N}]*"
        found = F.regexp_substr(text, F.lit(whole))
        start = F.char_length(F.element_at(F.split(text, whole, 2), 1))
        return F.when(found.isNotNull(), F.struct(start.cast("bigint").alias("start"), (start + F.char_length(found)).cast("bigint").alias("end")))

    words = [r"\Q" + w + r"\E" for w in term.split()]
    if not words:
        return F.lit(None).cast("struct<start: bigint, end: bigint>")
    return F.coalesce(first(r"\Q" + term.strip() + r"\E"), first(r"\s+".join(w + "(?:e?s)?" for w in words)))


def shootout(c: Column) -> tuple[Column, Column, Column]:
    """Winner and score of ``(X win a-b on Penalties)``."""
    p = r"\((.+?) win (\d+)-(\d+) on [Pp]enalties\)"
    part = lambda k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    return part(1), part(2).cast("bigint"), part(3).cast("bigint")


def knockout_round(c: Column) -> Column:
    """Round by keyword, third place before final."""
    low = F.lower(c)
    words = ((r"\b(?:third|3rd)\b|\bbronze\b", "third-place"), (r"\b(?:round of|last) 32\b", "round-of-32"), (r"\b(?:round of|last) 16\b", "round-of-16"), (r"\bquarter", "quarter-final"), (r"\bsemi", "semi-final"), (r"\bfinal\b", "final"))
    out = F.when(F.lit(False), F.lit(""))
    for word, name in words:
        out = out.when(low.rlike(word), F.lit(name))
    return out


def ordinal_readings(c: Column) -> Column:
    """All ways to cut a digit string into numbers of one or two digits without a leading zero."""
    def grow(acc: Column, i: Column) -> Column:
        digit, pair = F.substring(c, i, F.lit(1)), F.substring(c, i - 1, F.lit(2))
        one = F.when(digit != "0", F.transform(F.element_at(acc, -1), lambda r: F.concat(r, F.array(digit.cast("int"))))).otherwise(F.slice(F.element_at(acc, -1), 1, 0))
        two = F.when((i > 1) & (F.left(pair, F.lit(1)) != "0"), F.transform(F.element_at(acc, -2), lambda r: F.concat(r, F.array(pair.cast("int"))))).otherwise(F.slice(F.element_at(acc, -1), 1, 0))
        return F.concat(acc, F.array(F.concat(one, two)))

    none = F.array().cast("array<array<int>>")
    start = F.array(none, F.array(F.array().cast("array<int>")))
    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(c)), start, grow), -1)


class Readings:
    """Table function ``readings(digits, row_count)``: each way to cut a word of at most eight
    digits into numbers of one or two digits, none with a leading zero, none above the row
    count; ``parts`` are ``(start, end, ordinal)``. Null or other text has none."""

    MOST_DIGITS = 8

    def eval(self, digits: str, row_count: int):
        if not digits or row_count is None or len(digits) > self.MOST_DIGITS or not (digits.isascii() and digits.isdigit()):
            return
        done = [[] for _ in range(len(digits) + 1)]  # readings of the first k digits
        done[0] = [[]]
        for end in range(1, len(digits) + 1):
            for start in (end - 2, end - 1):
                if start >= 0 and digits[start] != "0" and int(digits[start:end]) <= row_count:
                    done[end] += [[*r, (start, end, int(digits[start:end]))] for r in done[start]]
        for n, parts in enumerate(done[-1], 1):
            yield n, parts


def register_readings(spark) -> None:
    spark.udtf.register("readings", F.udtf(Readings, returnType="reading int, parts array<struct<start: int, end: int, ordinal: int>>"))
