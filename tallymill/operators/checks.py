"""Reconciliation checks: one long table of results, and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(facts: DataFrame, name: str, key: str, page: Column, counterpart: Column, tolerance: float = 0.0) -> DataFrame:
    """``(check, key, page_value, counterpart, result)``: pass within the tolerance, not-applicable where a side is null."""
    out = facts.select(F.lit(name).alias("check"), F.col(key).cast("bigint").alias("key"), page.cast("double").alias("page_value"), counterpart.cast("double").alias("counterpart"))
    result = F.when(F.col("page_value").isNull() | F.col("counterpart").isNull(), "not-applicable").when(F.abs(F.col("page_value") - F.col("counterpart")) <= tolerance, "pass").otherwise("fail")
    return out.withColumn("result", result)


def summarised(checks: list[DataFrame]) -> DataFrame:
    """``(check, passed, failed, not_applicable, max_delta, result)`` of each check; pass iff all pass."""
    rows = reduce(DataFrame.unionByName, checks)
    n = lambda r: F.count_if(F.col("result") == r)
    verdict = F.when(n("fail") > 0, "fail").when(n("pass") > 0, "pass").otherwise("not-applicable")
    return rows.groupBy("check").agg(n("pass").alias("passed"), n("fail").alias("failed"), n("not-applicable").alias("not_applicable"), F.max(F.abs(F.col("page_value") - F.col("counterpart"))).alias("max_delta"), verdict.alias("result"))


def set_cover(rows: DataFrame, item: str, features: list[str]) -> list:
    """Greedy sample: items that cover most values not yet covered, ties to the
    lowest item, until all are covered. A round for each item of the cover; each is one
    aggregation and keeps one id on the driver."""
    chosen: list = []
    long = rows.unpivot([item], features, "feature", "value").where("value is not null").distinct()
    while True:
        covered = long.where(F.col(item).isin(chosen)).select("feature", "value").distinct()
        best = long.join(covered, ["feature", "value"], "left_anti").groupBy(item).count().orderBy(F.desc("count"), item).first()
        if best is None:
            break
        chosen.append(best[item])
    return chosen
