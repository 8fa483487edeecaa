"""Fuzzy line dedup by MinHash, in DataFrame operations only.

1. Lines are told apart by 128 bits of hash; equal lines are one class with their count.
2. A class's characters (code points) are cut into shingles of ``SHINGLE`` (a
   shorter line is one shingle). A generated row hashes ``STEP`` shingles at once,
   so the ``BANDS * ROWS`` minima take one update for each ``STEP`` of them, in
   generated code, and only minima are shuffled. Minima of one hash under different
   exclusive-or masks agree with the probability of the Jaccard similarity.
3. ``BANDS`` bands of ``ROWS`` minima: lines of similarity 0.8 meet in some band
   with probability 0.97, of 0.85 with 0.99, of 0.9 with 0.999.
4. Four bits of each minimum are kept. Two lines of which fewer than ``AGREE`` of
   the 15 agree are no candidates; at similarity 0.8 that loses one pair in 1,600.
5. Each band bucket links its members to one representative, its first.
6. After the verified links are contracted, a bucket that holds several components has
   strays: members outside its largest component. Pairs are compared by odd
   sketches: ``WORDS`` words of parities of the hashes of a set. As many bits as two
   sketches differ in, so many shingles at least are in one set alone, so a pair that
   the threshold's bound rules out is none for certain (sketches of lines of over about
   2,300 characters rule out less). First each stray meets ``HUBS`` members of its
   bucket, and of those of other components the ``PICKS`` of closest sketch are verified;
   most of a crowd of near copies is one component then. What is a stray after that
   meets all members of other components, so no candidate is left out, and rows grow
   with the strays and not with the square of the bucket.
7. Candidates are verified by exact Jaccard similarity of their shingle sets;
   distributed union-find makes components; the first place of each (lowest
   ``doc_id``, then line number) stays.

Tables that are broadcast are counted first and only when they fit
``BROADCAST_BYTES``; beyond it the same join is a shuffle join.

Defined results: lines of white space only are always kept and link nothing; a
null text stays null, an empty one has no lines; a document whose lines all go
keeps its row with an empty text; rows that repeat id and text are one document;
lines of null ids come after all others; extra columns pass through.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import components, discard, materialize, output_name

SIMILARITY = 0.8
SHINGLE = 8
BANDS, ROWS = 5, 3
#: Shingles that one generated row hashes.
STEP = 16
#: Of the kept parts of the minima, so many agree in every candidate.
AGREE = 7
#: Words of 64 parities in an odd sketch.
WORDS = 16
#: Members of a bucket that its strays meet before they meet all.
HUBS = 16
#: Of those, so many of the closest are verified.
PICKS = 3
BROADCAST_BYTES = 32 << 20
_RANDOM = random.Random(17)
_MASKS = [_RANDOM.getrandbits(64) - (1 << 63) for _ in range(BANDS * ROWS)]
_HASHES = [f"x{j}" for j in range(STEP)]
_CELLS = [f"s{w}" for w in range(WORDS)]


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, pos, line, h1, h2)`` of all lines that aren't blank."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^ \t\r\x0b\x0c]")).select("id", "th", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _place(column: str = "id") -> Column:
    """A struct that orders places by document, null ids last."""
    return F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("id"), F.col("th"), F.col("pos"))


def _hashed(lines: DataFrame, shingle: int) -> DataFrame:
    """For each ``STEP`` shingles of ``code``, text in UTF-32, a row with their hashes
    ``x0, x1, ...`` in its place, ``head`` in the first of them; the last row repeats the last shingle."""
    keys, code = [c for c in lines.columns if c != "code"], F.col("code")
    head = F.col("at_") == 0
    last = F.greatest((F.octet_length(code) / 4).cast("int") - shingle, F.lit(0))
    rows = lines.select(*keys, code, last.alias("last_"), F.explode(F.sequence(F.lit(0), last, F.lit(STEP))).alias("at_"))
    cut = lambda j: F.xxhash64(F.substring(code, F.least(F.col("at_") + j, F.col("last_")) * 4 + 1, F.lit(4 * shingle)))
    return rows.select(*keys, head.alias("head"), *(cut(j).alias(x) for j, x in enumerate(_HASHES)))


def _gathered(where: Column | None = None) -> Column:
    """An aggregate: all hashes of rows of ``_hashed``, repeats included."""
    row = F.array(*_HASHES)
    return F.flatten(F.collect_list(row if where is None else F.when(where, row)))


def signatures(lines: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """A row for each distinct line: ``(h1, h2, copies, bands, marks)``; the marks are four
    bits of each minimum."""
    rows = _hashed(lines.select("h1", "h2", F.encode("line", "UTF-32").alias("code")), shingle)
    least = (F.min(F.least(*(F.col(x).bitwiseXOR(F.lit(m)) for x in _HASHES))).alias(f"m{k}") for k, m in enumerate(_MASKS))
    one = rows.groupBy("h1", "h2").agg(F.count_if("head").alias("copies"), *least)
    bands = F.array(*(F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)))
    marks = F.lit(0).cast("long")
    for k in range(len(_MASKS)):
        marks = marks.bitwiseOR(F.shiftleft(F.xxhash64(f"m{k}").bitwiseAND(F.lit(15).cast("long")), 4 * k))
    return one.select("h1", "h2", "copies", bands.alias("bands"), marks.alias("marks"))


def _alike(x: str, y: str) -> Column:
    """Whether enough of the marks of two lines agree."""
    bits = F.col(x).bitwiseXOR(F.col(y))
    bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
    bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.bit_count(bits) <= len(_MASKS) - AGREE


def _apart(x: str, y: str) -> Column:
    """The bits in which two sketches differ."""
    return sum((F.bit_count(F.col(c + x).bitwiseXOR(F.col(c + y))) for c in _CELLS), F.lit(0))


def _near(x: str, y: str, similarity: float) -> Column:
    """Whether two sets, given as size and sketch, can be that similar: of sets with so
    much in common, (1 - s) / (1 + s) of both sizes at most is in one alone."""
    return _apart(x, y) * (1 + similarity) <= (1 - similarity) * (F.col("n" + x) + F.col("n" + y)) + 1e-6


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs ``(a, b)`` whose lines ``texts(node, code, n, s0, s1, ...)`` have the Jaccard
    similarity. Sets are of 64-bit hashes: those that are met are of two lines, in which
    unequal shingles of equal hash do not occur in practice."""
    told = ["n", *_CELLS]
    left, right = (texts.select(F.col("node").alias(side), F.col("code").alias("c" + side), *(F.col(c).alias(c + side) for c in told)) for side in "ab")
    both = pairs.join(left, "a").join(right, "b").where(_near("a", "b", similarity))
    halves = F.explode(F.array(F.struct(F.lit(True).alias("one"), F.col("ca").alias("code")), F.struct(F.lit(False).alias("one"), F.col("cb").alias("code"))))
    rows = _hashed(both.select("a", "b", "na", "nb", halves.alias("half")).select("a", "b", "na", "nb", "half.*"), shingle)
    sets = rows.groupBy("a", "b", "na", "nb").agg(_gathered(F.col("one")).alias("sa"), _gathered(~F.col("one")).alias("sb"))
    # a generated row keeps the optimizer from intersecting anew for each use
    sets = sets.select("a", "b", "na", "nb", F.explode(F.array(F.size(F.array_intersect("sa", "sb")))).alias("common"))
    return sets.where(F.col("common") >= similarity * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _texts(lines: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(node, code, n, s0, s1, ...)`` of the wanted classes ``(node, h1, h2)``: their line
    in UTF-32, which is cut by place without a search, the size of its set and its odd sketch."""
    texts = lines.select("h1", "h2", "line").join(bounded(wanted, 48), ["h1", "h2"]).groupBy("node").agg(F.first("line").alias("line"))
    texts = texts.select("node", F.encode("line", "UTF-32").alias("code"))
    sets = _hashed(texts, shingle).groupBy("node").agg(F.array_distinct(_gathered()).alias("set"))
    each = sets.select("node", F.explode("set").alias("h"))
    bit, word = F.shiftright("h", 8).bitwiseAND(F.lit(63).cast("long")).cast("int"), F.col("h").bitwiseAND(F.lit(WORDS - 1).cast("long"))
    # a hash goes to one word of its sketch; the words are put side by side afterwards
    odd = each.groupBy("node", word.alias("word")).agg(F.count("*").alias("n"), F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("odd"))
    parts = (F.coalesce(F.max(F.when(F.col("word") == w, F.col("odd"))), F.lit(0).cast("long")).alias(c) for w, c in enumerate(_CELLS))
    return texts.join(odd.groupBy("node").agg(F.sum("n").alias("n"), *parts), "node")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``(id, th, drop)``: of each document with lines that go, their numbers."""
    spark, scratch = docs.sparkSession, []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        scratch.append(materialize(df, tag))
        return scratch[-1]

    lines = _lines(docs, id_col, text_col)
    sig = kept(signatures(lines, shingle).withColumn("node", F.monotonically_increasing_id()), "line-signatures")
    keyed = sig.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("end"), F.count("*").alias("size")).where("size > 1")
    shared = kept(shared, "line-keys")
    met = kept(sig.select("node", "marks", F.explode("bands").alias("key")).join(bounded(shared, 40), "key"), "line-buckets")

    def linked(pairs: DataFrame) -> DataFrame:
        return kept(verified(pairs, texts, similarity, shingle), "line-links")

    reps = sig.select(F.col("node").alias("rep"), F.col("marks").alias("marked"))
    first = met.where("node <> rep").select("node", "marks", "rep").distinct().join(reps, "rep").where(_alike("marks", "marked")).select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b"))
    first = kept(first.distinct(), "line-pairs")
    # the one pair of a bucket of two is settled by its marks; larger buckets may hold further pairs
    touched = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(met.where("size > 2").select("node")).distinct()
    texts = kept(_texts(lines, sig.select("node", "h1", "h2").join(touched, "node", "left_semi"), shingle), "line-texts")
    links = linked(first)

    told = texts.drop("code").join(sig.select("node", "marks"), "node")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("key", *(F.col(c).alias(c + name) for c in ("node", "root", "main", "marks", "n", *_CELLS)))

    def met_by_strays(found: DataFrame, hubs: int | None) -> DataFrame:
        """``(a, b)``: pairs of different components in one bucket, of which one is outside
        the bucket's largest component; with ``hubs`` the
        closest of each stray to so many members."""
        rooted = met.where("size > 2").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("root"))
        parts = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts"))
        open_ = kept(rooted.join(parts.where("parts > 1").select("key", "main"), "key"), "line-open")
        full = open_.join(told, "node")
        partners = full
        if hubs:
            order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
            partners = open_.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= hubs).drop("turn").join(told, "node")
        x, y = side(full.where("root <> main"), "a"), side(partners, "b")
        on = (x["key"] == y["key"]) & (F.col("roota") != F.col("rootb")) & _alike("marksa", "marksb") & _near("a", "b", similarity)
        if not hubs:
            on = on & ((F.col("nodea") > F.col("nodeb")) | (F.col("rootb") == F.col("mainb")))
        pairs = x.join(y, on).select(F.greatest("nodea", "nodeb").alias("a"), F.least("nodea", "nodeb").alias("b"), F.col("nodea").alias("stray"), _apart("a", "b").alias("apart"))
        if hubs:
            closest = F.slice(F.array_sort(F.collect_set(F.struct("apart", "a", "b"))), 1, PICKS)
            pairs = pairs.groupBy("stray").agg(closest.alias("picks")).select(F.explode("picks").alias("pick")).select("pick.*")
        return pairs.select("a", "b").distinct()

    tried = first
    for hubs in (HUBS, None):
        pairs = kept(met_by_strays(components(links), hubs).join(tried, ["a", "b"], "left_anti"), "line-pairs")
        links, tried = links.unionByName(linked(pairs)), tried.unionByName(pairs)
    node_class = components(links)

    # of all places of a component, or of a class with copies, the first stays
    wanted = sig.select("node", "h1", "h2", "copies").join(node_class, "node", "left").where("copies > 1 or component is not null")
    wanted = kept(wanted.select("h1", "h2", F.coalesce("component", "node").alias("class")), "line-classes")
    places = kept(lines.select("id", "th", "pos", "h1", "h2").join(bounded(wanted, 48), ["h1", "h2"]).select("class", "id", "th", "pos"), "line-places")
    heads = kept(places.groupBy("class").agg(F.min(_place()).alias("head")), "line-heads")
    gone = places.join(bounded(heads, 48), "class").where(_place() != F.col("head"))
    out = materialize(gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("drop")), "line-drops")
    for old in scratch:
        discard(spark, old.scratch)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, counts: bool = False) -> DataFrame:
    """``docs`` with one line of each component left in the texts; with ``counts``
    also ``n_lines`` and ``n_dropped`` of each row."""
    drops = duplicate_lines(docs, id_col, text_col, similarity, shingle)
    size = drops.agg(F.sum(F.size("drop") * 4 + 48)).first()[0] or 0
    taken = docs.columns
    key, hashed, gone, total = (output_name(taken, n) for n in ("line_id", "line_hash", "line_drop", "n_lines"))
    dropped = output_name([*taken, total], "n_dropped")
    drops = drops.select(F.col("id").alias(key), F.col("th").alias(hashed), F.col("drop").alias(gone))
    text = F.col(text_col).cast("string")
    rows = docs.withColumns({key + "_": F.col(id_col).cast("long"), hashed + "_": F.xxhash64(text)})
    on = F.col(key + "_").eqNullSafe(F.col(key)) & (F.col(hashed + "_") == F.col(hashed))
    joined = rows.join(F.broadcast(drops) if size <= BROADCAST_BYTES else drops, on, "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = [F.when(F.col(gone).isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in taken]
    if counts:
        out += [F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias(total), F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long").alias(dropped)]
    return joined.select(*out)
