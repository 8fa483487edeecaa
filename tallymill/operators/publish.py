"""Artifacts: canonical JSON, staged swaps, payload budgets, id pins."""

from __future__ import annotations

import gzip
import json
import os
import shutil
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: object) -> str:
    """Sorted keys, indent 2, nulls written, a newline at the end."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """``(key, json)`` with fields in name order and nulls written."""
    return df.select(F.col(key), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


@F.pandas_udf(T.LongType())
def gzip_size(s: pd.Series) -> pd.Series:
    """Compressed bytes of each payload."""
    return s.map(lambda t: len(gzip.compress((t or "").encode(), 9, mtime=0)))


def over_budget(payloads: DataFrame, key: str, payload: str, budget: int) -> DataFrame:
    """Payloads beyond the budget, and one row ``*`` if all of them together are."""
    sized = payloads.select(F.col(key).cast("string").alias("artifact"), gzip_size(payload).alias("bytes"))
    total = sized.groupBy(F.lit("*").alias("artifact")).agg(F.sum("bytes").alias("bytes"))
    return sized.unionByName(total).where(F.col("bytes") > budget)


def write_artifacts(rows: DataFrame, folder: str, key: str, payload: str) -> int:
    """One file for each row of a *published set* (artifacts fit a static site),
    staged beside the target and swapped as a whole: all or none."""
    target = Path(folder)
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}-"))
    n = 0
    try:
        for row in rows.select(key, payload).toLocalIterator():
            (stage / f"{row[key]}.json").write_text(canonical(json.loads(row[payload])), encoding="utf-8")
            n += 1
        swap(stage, target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    return n


def swap(stage: Path, target: Path) -> None:
    """Put ``stage`` in the place of ``target``; the old folder returns if that fails."""
    old = target.with_name(f".{target.name}-old")
    shutil.rmtree(old, ignore_errors=True)
    had = target.exists()
    if had:
        os.replace(target, old)
    try:
        os.replace(stage, target)
    except OSError:
        if had:
            os.replace(old, target)
        raise
    shutil.rmtree(old, ignore_errors=True)


def lost_pins(published: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Published ids that the registry no longer has: must be empty."""
    return published.select(key).distinct().join(registry.select(key), key, "left_anti")
