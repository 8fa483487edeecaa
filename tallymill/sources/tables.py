"""Readers of the driver tables and of published artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clustered(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows dealt by ``key`` to tasks of about ``rows`` rows, however many there are: the number
    of tasks grows with the table, and groupings, windows and joins by the key (and more) need no further shuffle."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, key)


def read_records(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """JSON records under a declared schema. A record that does not parse or
    lacks a required field fails the read with its text, instead of becoming nulls."""
    raw = spark.read.text(path, wholetext=False)
    parsed = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value")
    missing = " or ".join(f"r.{c} is null" for c in required) or "false"
    bad = F.expr(f"r is null or {missing}")
    return parsed.select(F.when(bad, F.raise_error(F.concat(F.lit("bad record: "), F.left("value", F.lit(200))))).otherwise(F.col("r")).alias("r")).select("r.*")


def records_in_manifest(records: DataFrame, manifest: DataFrame, key: str, statuses: tuple[str, ...] = ("extracted", "skipped-unchanged")) -> DataFrame:
    """Records whose key the manifest lists with one of the statuses; both tables
    are matched by a semi join, so neither is multiplied."""
    return records.join(manifest.where(F.col("status").isin(*statuses)).select(key), key, "left_semi")


def scan_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Binary files by name pattern: path, length, content hash; content is only
    read where the hash is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return files.select("path", stem.alias("stem"), "length", F.sha2("content", 256).alias("content_hash"))


def manifest_of_names(names: DataFrame, column: str) -> DataFrame:
    """Number and two codes from names like ``M012 abc v def``; one row a number,
    the first name in text order, sorted by number."""
    parts = names.select(
        F.regexp_extract(column, r"^M(\d+)", 1).alias("number"), F.upper(F.regexp_extract(column, r"^M\d+ (\w+)", 1)).alias("home"),
        F.upper(F.regexp_extract(column, r" v (\w+)", 1)).alias("away"), F.col(column).alias("name"),
    ).where("number <> ''")
    return parts.groupBy(F.col("number").cast("bigint").alias("number")).agg(F.min(F.struct("name", "home", "away")).alias("r")).select("number", "r.*").orderBy("number")
