"""Positioned spans of pages, and the identity block of a report's cover.

A page is read as text runs laid on a grid: each block element starts a line, each
character advances a run by ``WIDTH``. A page that cannot be read becomes one row
with what is wrong in ``error``; the others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, LINE, HEIGHT = 5.0, 12.0, 10.0
#: Elements that start a line.
BLOCKS = ("article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "section", "table", "td", "th", "tr", "ul")
#: Named characters that are read; others stay as they are printed.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
BODY = r"(?is)<body[^>]*>(.*)</body>"
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TOKEN = r"<[^>]*>|[^<]+"
TAG = r"^</?([a-zA-Z0-9]+)"
INK = r"[^ \t\n\f\r]"
SPANS = "span long, x0 double, y0 double, x1 double, y1 double, text string, error string"
_body, _hidden, _token, _tag, _ink = map(re.compile, (BODY, HIDDEN, TOKEN, TAG, INK))
_blocks = frozenset(BLOCKS)


class PageError(ValueError):
    """What makes a page unreadable."""


def page_spans(html: str | None) -> Iterator[tuple[int, float, float, float, float, str]]:
    """``(span, x0, y0, x1, y1, text)`` of every run that shows ink, in order."""
    if html is None:
        raise PageError("no page")
    body = _body.search(html)
    if body is None:
        raise PageError("no complete body")
    n = line = at = 0
    for token in _token.findall(_hidden.sub("", body.group(1))):
        if token[0] == "<":
            name = _tag.match(token)
            if name and name.group(1).lower() in _blocks:
                line, at = line + 1, 0
            continue
        for written, meant in NAMED:
            token = token.replace(written, meant)
        if _ink.search(token):
            n += 1
            yield n, at * WIDTH, line * LINE, (at + len(token)) * WIDTH, line * LINE + HEIGHT, token
        at += len(token)


def _rows(html: str | None) -> list[tuple]:
    try:
        return [(*s, None) for s in page_spans(html)]
    except PageError as error:
        return [(None, None, None, None, None, None, str(error))]


def spans(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, span, x0, y0, x1, y1, text, error)``; no shuffle. Repeated pages are each read."""
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string())
    names = [key, *(part.split()[0] for part in SPANS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 256):  # spans are several times a page
                part = batch.slice(s, 256)
                found = [_rows(page) for page in part.column(1).to_pylist()]
                keys = part.column(0).take(pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64()))
                columns = list(zip(*(r for rows in found for r in rows))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names=names)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).cast("string").alias("html")).mapInArrow(run, f"{key} {kind}, {SPANS}")


class PageSpans:
    """The same as a table function of SQL: ``FROM pages, LATERAL page_spans(html)``."""

    def eval(self, html: str):
        yield from _rows(html)


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_spans", F.udtf(PageSpans, returnType=SPANS))


# --- covers ------------------------------------------------------------------------------

DATE, KICKOFF, GROUP = r"^(\d{1,2}) ([A-Z][a-z]+) (\d{4})$", r"^(\d{1,2}):(\d{2}) Kick Off$", r"^Group ([A-Z])\b"
SCORE, SHOOTOUT, SUFFIX = r"^(\S.*?) (\d+) - (\d+) (\S.*)$", r"(?i)^\(.*\bon Penalties\)$", r"\s*\([^)]*\)\s*$"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def covers(lines: DataFrame, by: str, line: str, text: str, title: str) -> DataFrame:
    """One row for each report of its cover's lines (numbered one by one from the top):
    ``home, away, home_score, away_score, stage, group, match_date, kickoff, venue,
    shootout, note``, or only ``problem`` where the block does not have its shape.

    The shape: scoreline, perhaps a shoot-out, stage, date, kick-off, venue, title, each
    right below the last; one date and one kick-off in all. The first rule that does
    not hold is the problem; a bad report never stops the others.
    """
    rows = lines.select(by, F.col(line).alias("n"), F.col(text).alias("t"))
    is_date, is_kick = F.col("t").rlike(DATE), F.col("t").rlike(KICKOFF)
    marks = rows.groupBy(by).agg(F.count_if(is_date).alias("dates"), F.min(F.when(is_date, F.col("n"))).alias("at"), F.count_if(is_kick).alias("kicks"), F.min(F.when(is_kick, F.col("n"))).alias("kick"))
    near = rows.join(marks.select(by, "at", "kick"), by).withColumn("k", F.col("n") - F.col("at"))
    slot = lambda name, k: F.max(F.when(F.col("k") == k, F.col("t"))).alias(name)
    below = lambda name, k: F.max(F.when(F.col("n") - F.col("kick") == k, F.col("t"))).alias(name)
    block = near.where("k between -3 and 0 or n - kick between 0 and 2").groupBy(by).agg(
        slot("m3", -3), slot("m2", -2), slot("stage_", -1), slot("date_", 0), below("kick_", 0), below("venue_", 1), below("title_", 2)
    )
    b = marks.join(block, by, "left")
    shot = F.coalesce(F.col("m2").rlike(SHOOTOUT), F.lit(False))
    b = b.withColumn("shot_", F.when(shot, F.col("m2"))).withColumn("score_", F.when(shot, F.col("m3")).otherwise(F.col("m2")))
    part = lambda c, pattern, k: F.regexp_extract(c, pattern, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part("date_", DATE, 2))
    b = b.withColumn("day_", F.try_to_date(F.concat_ws("-", part("date_", DATE, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part("date_", DATE, 1), 2, "0")), "yyyy-MM-dd"))
    said = part("score_", SCORE, 4)
    away = F.regexp_replace(said, SUFFIX, "")
    c, no = F.col, lambda x: F.coalesce(~x, F.lit(True))
    problem = (
        F.when(c("dates") == 0, "no date line").when(c("dates") > 1, "several date lines").when(c("kicks") == 0, "no kick-off line").when(c("kicks") > 1, "several kick-off lines")
        .when(month == 0, "unknown month").when(c("day_").isNull(), "not a real date").when(c("kick") != c("at") + 1, "kick-off not below the date")
        .when(c("m2").isNull() | c("stage_").isNull(), "no scoreline and stage").when(c("stage_").rlike(SCORE), "no stage line").when(c("score_").isNull(), "shoot-out without scoreline")
        .when(no(c("score_").rlike(SCORE)), "not a scoreline").when(c("venue_").isNull() | c("title_").isNull(), "no venue and title")
        .when(c("venue_").contains(title) | c("venue_").rlike(DATE) | c("venue_").rlike(KICKOFF), "not a venue").when(~c("title_").contains(title), "no title below the venue").when(away == "", "no away team")
    )
    kick = F.concat(F.lpad(part("kick_", KICKOFF, 1), 2, "0"), F.lit(":"), part("kick_", KICKOFF, 2))
    fields = {
        "home": part("score_", SCORE, 1), "away": away, "home_score": part("score_", SCORE, 2).try_cast("int"), "away_score": part("score_", SCORE, 3).try_cast("int"), "stage": c("stage_"),
        "group": F.nullif(part("stage_", GROUP, 1), F.lit("")), "match_date": c("day_"), "kickoff": kick, "venue": c("venue_"), "shootout": c("shot_"), "note": F.when(away != said, F.lit("suffix after the away team")),
    }
    ok = c("problem").isNull()
    return b.withColumn("problem", problem).select(by, *(F.when(ok, v).alias(k) for k, v in fields.items()), "problem")
