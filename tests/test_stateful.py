"""Streams with state, in several batches and over a restart, against the batch operators on the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import relational as R
from driftline.streaming import stateful as S

SCHEMA = "player string, at double, n long"


@pytest.fixture(scope="module")
def parts():
    """Rows in the order of their time, cut into files; one player is in some of them only."""
    rng, t, rows = random.Random(6), 0.0, []
    for n in range(240):
        t += rng.choice([1.0, 5.0, 40.0, 300.0])
        rows.append((rng.choice("aaabc"), t, n))
    return [rows[i : i + 48] for i in range(0, 240, 48)]


def streamed(spark, folder, parts, operator, name):
    """The stream's output, stopped and started again after the second file."""
    for k, v in S.PROVIDER.items():
        spark.conf.set(k, v)
    source, out, mark = (f"{folder}/{n}" for n in ("in", "out", "mark"))
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if i in (1, len(parts) - 1):
            rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            operator(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(out).collect()))


@pytest.mark.parametrize("forget", [0.0, 1e9])
def test_rejoins_over_batches(spark, tmp_path, parts, forget):
    seeds = spark.createDataFrame([("a", -50.0), ("b", -1000.0)], "player string, last_seen double")
    got = streamed(spark, str(tmp_path), parts, lambda rows: S.rejoins(rows, ["player"], "at", 300.0, forget, seeds=seeds), "r")
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    want = sorted(map(tuple, R.rejoins(whole, ["player"], "at", 300.0, seeds).select("player", "at", "n", "gap_s").collect()))
    assert got == want and len(want) > 20 and any(r[3] == 300.0 for r in want)


def test_tokens_over_batches(spark, tmp_path, parts):
    got = streamed(spark, str(tmp_path), parts, lambda rows: S.token_bucket(rows, ["player"], "at", 0.02, 3.0), "t")
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    want = sorted(map(tuple, R.token_bucket(whole, "player", "at", 0.02, 3.0).collect()))
    assert [(r[0], r[1], r[3]) for r in got] == want and {r[2] for r in want} == {True, False}
    assert all((r[4] == 0) == r[3] and r[4] <= 50 for r in got)


def test_a_key_is_forgotten_when_the_watermark_passes(spark, tmp_path):
    parts = [[("a", 100.0, 0), ("b", 100.0, 1)], [("b", 5000.0, 2)], [("b", 10_000.0, 3)], [("b", 10_001.0, 4)], [("a", 10_100.0, 5)]]
    got = streamed(spark, str(tmp_path), parts, lambda rows: S.rejoins(rows, ["player"], "at", 100.0, 600.0, 10.0), "f")
    assert [(r[2], r[3]) for r in got if r[0] == "a"] == [(0, None), (5, None)]


def test_buckets_are_kept_until_full(spark):
    with pytest.raises(ValueError):
        S.token_bucket(spark.createDataFrame([], SCHEMA).withColumn("x", F.lit(1)), ["player"], "at", 0.1, 10.0, 50.0)
