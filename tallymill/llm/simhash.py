"""SimHash near-duplicates by tiled exact comparison.

``fingerprints`` gives each text the majority bits of the XXH64 hashes of its
three-word shingles. ``near_pairs`` finds every pair of distinct fingerprints
that differ in at most ``RADIUS`` bits:

* Fingerprints are dealt to tiles by population count and by the value of one of
  ``radius + 1`` bit blocks: two that differ in at most the radius agree in at
  least one block, so no pair is lost (tiles of population counts alone are met by
  a third of all pairs, which grows with the square of the table). A tile that
  holds over ``8 * TILE`` is cut further by a salt.
* Tile pairs of one block value whose population counts differ beyond the radius
  are skipped: each tile is sent only to the groups in which it meets the others,
  so one crowded block spreads over many tasks.
* Within a tile pair all pairs are compared exactly, by numpy exclusive-or and bit
  counts over whole arrays.

Equal fingerprints collapse to one before any of this; links inside a tile
leave it as a spanning forest, so a crowd of near copies gives linear rows.

Defined results: a null text is an empty one (fingerprint zero, which links
like any other); rows that repeat a ``doc_id`` each get a row; null ids take
part in components but never name one unless no other id is there (then the
component is null); an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.llm.common import as_bytes, components, forest, materialize, output_name

RADIUS = 2
SHINGLE = 3
TILE = 512
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text in UTF-8."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        digests = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        digests = [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    hashes = np.array(digests, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of each row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter(map(fingerprint, as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def blocks(radius: int) -> list[tuple[int, int]]:
    """Lowest bit and width of the ``radius + 1`` blocks that deal fingerprints to tiles."""
    if not 0 <= radius < 64:
        raise ValueError("a radius is from 0 to 63 bits")
    ends = [-(-64 * k // (radius + 1)) for k in range(radius + 2)]
    return [(low, high - low) for low, high in zip(ends[:-1], ends[1:])]


def _block(fp: Column, number: int, low: int, width: int) -> Column:
    """The value of a block with its number."""
    value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    return F.struct(F.lit(number).alias("block"), value.alias("value"))


def _compare(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius among rows of equal ``key`` (sorted).

    ``side`` is 0 for tiles that meet themselves, else 1 or 2: then only rows of
    different sides meet. Lag by lag, one exclusive-or and bit count over all
    rows whose group reaches that far.
    """
    n = len(key)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.repeat(np.concatenate((new[1:], [n])), np.diff(np.concatenate((new, [n]))))
    at, left, right, lag = np.arange(n), [], [], 1
    pop = np.bitwise_count(fp).astype(np.int16)
    while True:
        at = at[at + lag < end[at]]
        if not len(at):
            break
        other = at + lag
        ok = (np.abs(pop[at] - pop[other]) <= radius) & ((side[at] == 0) | (side[at] != side[other]))
        i, j = at[ok], other[ok]
        hit = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        left.append(i[hit])
        right.append(j[hit])
        lag += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def near_pairs(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(a, b)``: the links between distinct fingerprints of ``fps(fp)`` that
    differ in at most ``radius`` bits, as a spanning forest of each tile: ``b``
    is the first fingerprint of the tile that links of the tile reach from ``a``."""
    keyed = fps.select("fp", F.explode(F.array(*(_block(F.col("fp"), k, *b) for k, b in enumerate(blocks(radius))))).alias("key")).select("fp", "key.*")
    crowd = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(crowd, ["block", "value"])

    # tiles by population count p and a salt s; a fingerprint goes to each pair its tile is in
    pop, cuts = F.bit_count("fp"), F.ceil(F.col("n") / F.lit(8 * tile)).cast("int")
    salt = F.pmod(F.xxhash64("fp"), cuts).cast("int")
    here = pop * cuts + salt
    others = F.transform(
        F.sequence(F.greatest(pop - radius, F.lit(0)) * cuts, (F.least(pop + radius, F.lit(64)) + 1) * cuts - 1),
        lambda t: F.struct(
            F.least(t, here).alias("t0"), F.greatest(t, here).alias("t1"), F.when(t == here, 0).when(here < t, 1).otherwise(2).cast("int").alias("side")
        ),
    )
    group = ["block", "value", "t0", "t1"]
    dealt = met.select("block", "value", "fp", F.explode(others).alias("m")).select("block", "value", "m.t0", "m.t1", "m.side", "fp")
    parts = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate(([0], (np.diff(table[:4], axis=1) != 0).any(axis=0).astype(np.int64))))
            fp = table[5].view(np.uint64)
            i, j = _compare(group, table[4], fp, radius)
            # the forest of each group by itself: a node is a row of the table
            label = forest(i, j, len(group))
            child = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(table[5][child]), pa.array(table[5][label[child]])], names=["a", "b"])

        held = np.zeros((6, 0), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])), axis=1)
            last = (held[:4] != held[:4, -1:]).any(axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield links(held[:, :cut])
                held = held[:, cut:]
        if held.shape[1]:
            yield links(held)

    return parts.mapInArrow(run, "a long, b long")


def named(rows: DataFrame, links: DataFrame | None = None, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(fp, root, component_id)`` of each fingerprint of ``rows(id, fp)`` under the
    links ``(a, b)``; those within the radius where none are given."""
    heads = materialize(rows.groupBy("fp").agg(F.min("id").alias("head")), "simhash-heads")
    # Components over fingerprints; each then takes the smallest id under its fingerprints.
    linked = components(near_pairs(heads.select("fp"), radius, tile) if links is None else links)
    grouped = heads.join(linked, heads["fp"] == linked["node"], "left").select(heads["fp"], "head", F.coalesce("component", heads["fp"]).alias("root"))
    return grouped.join(grouped.groupBy("root").agg(F.min("head").alias("component_id")), "root").select("fp", "root", "component_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` of each row, and ``(fp, root, component_id)`` of each fingerprint."""
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash")
    return rows, named(rows, None, radius, tile)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fingerprint, component_id)``."""
    rows, named = _classes(docs, id_col, text_col, radius, tile)
    return rows.join(named.drop("root"), "fp", "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Ids up to this size are broadcast to filter the texts; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component left: the one of smallest id.

    Rows that repeat the kept id stay one. Rows of null id go where their
    component has an id; of a component of only null ids one row stays.
    """
    return drop_classes(docs, *_classes(docs, id_col, text_col, radius, TILE), id_col, text_col)


def drop_classes(docs: DataFrame, rows: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``drop_near_duplicates`` by the components of ``named`` over ``rows(id, fp)``."""
    judged = materialize(rows.join(named, "fp", "left").select("id", "root", "component_id"), "simhash-judged")
    gone = judged.where("id is not null and id <> component_id").select(F.col("id").alias(id_col)).distinct()
    again = judged.where("id = component_id").groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col))
    known = docs.where(F.col(id_col).isNotNull())
    size = gone.count() * 16
    kept = known.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, id_col, "left_anti").select(docs.columns)
    if again.limit(1).count():
        kept = kept.join(again, id_col, "left_anti").select(docs.columns).unionByName(kept.join(again, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col]))
    if judged.where("id is null").limit(1).count():
        lost = docs.where(F.col(id_col).isNull())
        probe, where = output_name(docs.columns, "fp"), len(docs.columns)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.fromiter(map(fingerprint, as_bytes(batch.column(where))), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns[:where], pa.array(bits.view(np.int64))], names=batch.schema.names)

        schema = T.StructType([*docs.schema.fields, T.StructField(probe, T.LongType())])
        marked = lost.withColumn(probe, F.col(text_col).cast("string")).mapInArrow(add, schema)
        alone = named.where("component_id is null").select(F.col("fp").alias(probe), F.col("root").alias(f"{probe}_root"))
        kept = kept.unionByName(marked.join(alone, probe).dropDuplicates([f"{probe}_root"]).select(docs.columns))
    return kept
