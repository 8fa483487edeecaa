"""Bounded training samples of labelled documents, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: Column | str) -> Column:
    """Rows whose CRC-32 of the id's text is 0 modulo ``FOLDS`` are never learnt from; null ids neither."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def low_hashes(order: Column, wanted: int, total: int) -> Column:
    """Whether a 64-bit hash is among the lowest share in which some more than
    ``wanted`` of ``total`` rows are expected. A filter ahead of a sorted limit, so
    that tasks hand over what is needed and not ``wanted`` rows each."""
    share = min(1.0, (1.5 * wanted + 100) / max(1, total))
    return F.lit(True) if share >= 1 else order < F.lit(int(-(1 << 63) + share * (1 << 64)))


def sample_ids(labels: DataFrame, label_col: str, per_class: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """``(id, label)``: of each class at most so many learnable ids, lowest hash
    first, so the choice doesn't depend on partitions. An id labelled both ways
    counts as the larger label."""
    one = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    one = one.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.lit("sample"), F.col("id"))
    sizes = {r.label: r["count"] for r in one.where(F.col("label").isin(list(per_class))).groupBy("label").count().collect()}
    parts = [one.where((F.col("label") == k) & low_hashes(order, n, sizes.get(k, 0))).orderBy(order, "id").limit(n) for k, n in sorted(per_class.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_rows(docs: DataFrame, ids: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, text, label)`` of the sampled ids. ``ids`` is bounded by its limits
    (a few 10,000 rows of two numbers), so it is broadcast."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.join(F.broadcast(ids), "id")
