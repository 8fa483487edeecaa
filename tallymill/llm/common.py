"""Shared pieces of the corpus operators: storage for intermediate tables,
connected components over DataFrames, and array helpers for Arrow batches."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and all tasks run in the driver's process (tests
    on one machine) a local folder is made and remembered in the session; on a
    cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tallymill/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    leaves files that survive a lost executor. The path is kept as ``.scratch``."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows ``(a, b)``.

    Returns ``(node, component)`` for every node that has an edge to another
    node; ``component`` is the smallest node reachable. Null ends and self
    loops are ignored, repeated edges count once.

    Alternates the large-star and small-star contractions: every round makes
    all nodes point at smaller nodes, so the number of edges never grows and
    the rounds grow with the logarithm of a path's length. Each round is one
    table in the shared folder; nothing is collected except two numbers.
    Everything is built from DataFrame operations.
    """
    spark = edges.sparkSession
    cur = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # v > u keeps the larger ends; u itself hangs below its own minimum by the edge (u, m)
        least2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least2, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        new = materialize(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        discard(spark, cur.scratch)
        cur = new
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = cur.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest index its links reach.

    ``a[i]`` and ``b[i]`` are linked. Hooks roots onto smaller roots, then jumps
    pointers, until no link joins two labels.
    """
    label = np.arange(n)
    a, b = np.asarray(a), np.asarray(b)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
    return label


def as_bytes(column) -> list:
    """UTF-8 bytes (or None) of each row of an Arrow string column, not decoded."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def output_name(taken: list[str], wanted: str) -> str:
    """A helper column's name that no column of the input has."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


#: For ``str.translate``: lower-cases A-Z alone.
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def pieces(text: str, word: re.Pattern, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about ``size`` characters that cut no match of ``word``, a
    pattern of one repeated class."""
    s = 0
    while len(text) - s > size:
        met = word.match(text, s + size - 1)
        e = met.end() if met else s + size
        yield text[s:e]
        s = e
    yield text[s:] if s else text


def slices(batch, column: int, size: int = 1 << 22):
    """An Arrow batch in slices of about ``size`` bytes of a string column, so that what a
    task makes of the texts does not grow with the batch; a longer text is alone."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    s = 0
    while s < len(ends):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + size, "right")))
        yield batch.slice(s, e - s)
        s = e
