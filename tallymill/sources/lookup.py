"""One artifact by its id: a table laid out for it, guarded reads, a memo of an index."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.matching import must


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def lay_out(df: DataFrame, path: str, key: str, version: str, buckets: int) -> None:
    """Writes ``df`` so that a read by ``key`` opens one bucket's files: a folder for each
    bucket of the key's hash, sorted by the key, with the version of its shape in each row.
    A bucket is to hold some 100 MB, so ``buckets`` grows with the table."""
    laid = df.withColumn("version_", F.lit(version)).withColumn("bucket_", _bucket(F.col(key), buckets))
    laid.repartition("bucket_").sortWithinPartitions("bucket_", key).write.partitionBy("bucket_").parquet(path)


def read_one(spark: SparkSession, path: str, key: str, value: Any, version: str, buckets: int) -> DataFrame:
    """The row whose ``key`` is ``value``: folder and files are pruned in the plan. No row, several
    rows, and a row of another version fail when it runs."""
    found = spark.read.parquet(path).where((F.col("bucket_") == _bucket(F.lit(value), buckets)) & (F.col(key) == F.lit(value)))
    names = [c for c in found.columns if c not in ("version_", "bucket_")]
    # an aggregate without groups has its row even where nothing was found
    one = found.agg(F.count("*").alias("n"), F.min("version_").alias("low"), F.max("version_").alias("high"), F.first(F.struct(*names)).alias("row"))
    ok = must(F.col("n") == 1, must((F.col("low") == version) & (F.col("high") == version), F.col("row"), f"the artifact is not of version {version}"), f"there is not exactly one artifact {value}")
    return one.select(ok.alias("row")).select("row.*")


class Memo:
    """Loads once, whoever asks at the same time; a load that failed is tried again by the next."""

    def __init__(self, load: Callable[[], DataFrame]):
        self.load, self.lock, self.held = load, threading.Lock(), None

    def get(self) -> DataFrame:
        with self.lock:
            if self.held is None:
                found = self.load().persist()
                try:
                    found.count()
                except BaseException:
                    found.unpersist()
                    raise
                self.held = found
            return self.held

    def reset(self) -> None:
        with self.lock:
            if self.held is not None:
                self.held.unpersist()
            self.held = None
