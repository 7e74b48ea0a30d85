"""Bracketing joins against plain loops: blocks, ties, hot keys and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import asof as J


def plain(times, samples):
    best = {}
    for k, t, v in samples:
        if t is not None:
            best[k, t] = min(best.get((k, t), v), v, key=lambda x: (x is not None, x or 0))
    out = []
    for n, k, t in times:
        mine = sorted((u, v) for (j, u), v in best.items() if j == k) if t is not None else []
        before, after = [x for x in mine if x[0] <= t] if mine else [], [x for x in mine if x[0] >= t] if mine else []
        out.append((n, before[-1] if before else None, after[0] if after else None))
    return sorted(out)


@pytest.mark.parametrize("block", [1.0, 7.5, 1e9])
def test_brackets_equal_plain_loops(spark, block):
    rng = random.Random(3)
    hot = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    samples = [(hot(), float(rng.randrange(300)) / 2, rng.randrange(50)) for _ in range(160)] + [("a", None, 1), ("hot", 3.0, 9), ("hot", 3.0, 2)]
    times = [(n, hot(), float(rng.randrange(-40, 360)) / 2) for n in range(250)] + [(900, "hot", None), (901, "nobody", 5.0), (902, "hot", 3.0)]
    times_df = spark.createDataFrame(times, "n int, k string, t double")
    samples_df = spark.createDataFrame(samples, "k string, t double, v int")
    got = J.bracketed(times_df, samples_df, ["k"], "t", block).collect()
    assert sorted((r["n"], tuple(r["before"]) if r["before"] else None, tuple(r["after"]) if r["after"] else None) for r in got) == plain(times, samples)
    none = J.bracketed(times_df, samples_df.limit(0), ["k"], "t", block)
    assert none.count() == len(times) and none.filter("before is not null or after is not null").count() == 0


def test_values_between_samples(spark):
    samples = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 20.0), ("a", 100.0, 0.0)], "k string, t double, x double")
    times = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 2.5, 10.0, 50.0, 100.0, 101.0)], "k string, t double")
    rows = J.bracketed(times, samples, ["k"], "t", 4.0).select("t", J.interpolated("x", "t", 30.0).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == {-1.0: None, 0.0: 0.0, 2.5: 5.0, 10.0: 20.0, 50.0: None, 100.0: 0.0, 101.0: None}


def test_a_hot_key_is_split(spark):
    samples = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("t"), F.col("id").alias("v"))
    times = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") + 0.5).alias("t"))
    rows = J.bracketed(times, samples, ["k"], "t", 100.0)
    assert rows.filter("before.v <> t - 0.5 or after.v <> t + 0.5").count() == 0 and rows.filter("after is null").count() == 1
