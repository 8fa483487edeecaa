"""Reads of one artifact, the memo of an index, and the row before in dealt groups."""

import random
import re
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymill.operators import sequence
from tallymill.sources import lookup


def test_a_read_opens_one_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/laid"
    lookup.lay_out(spark.range(200).select("id", (F.col("id") * 2).alias("v")), path, "id", "v3", 8)
    one = lookup.read_one(spark, path, "id", 77, "v3", 8)
    assert [tuple(r) for r in one.collect()] == [(77, 154)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket_#\d+ = \d", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(id,77\)", plan)
    with pytest.raises(PySparkException, match="not of version v4"):
        lookup.read_one(spark, path, "id", 77, "v4", 8).collect()
    with pytest.raises(PySparkException, match="exactly one artifact 999"):
        lookup.read_one(spark, path, "id", 999, "v3", 8).collect()
    twice = f"file://{tmp_path}/twice"
    lookup.lay_out(spark.range(3).union(spark.range(3)), twice, "id", "v3", 8)
    with pytest.raises(PySparkException, match="exactly one artifact 2"):
        lookup.read_one(spark, twice, "id", 2, "v3", 8).collect()


def test_memo_loads_once_and_resets_after_failure(spark):
    loads = []

    def load():
        loads.append(1)
        if len(loads) == 1:
            raise OSError("gone")
        return spark.range(5)

    memo = lookup.Memo(load)
    with pytest.raises(OSError):
        memo.get()
    threads = [threading.Thread(target=memo.get) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(loads) == 2 and memo.get().count() == 5
    memo.reset()
    assert memo.get().count() == 5 and len(loads) == 3


def test_previous_is_a_lag(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 60), k, rng.choice([None, k])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, t int, k int, v int")
    got = {r.k: r.previous for r in sequence.previous(df, ["g"], ["t", "k"], "v", F.floor(F.col("t") / 7)).collect()}
    for g in ("a", "b", None):
        of = sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:3])
        of.sort(key=lambda r: r[1:3])
        assert [got[r[2]] for r in of] == [None, *(r[3] for r in of[:-1])]
