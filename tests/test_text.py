"""Numbers as printf has them, sentences whole, and what a line may show."""

import json
import random

from pyspark.sql import functions as F

from driftline.functions import text as X
from driftline.sources import text as T


def test_numbers_are_rounded_from_their_exact_value(spark):
    rng = random.Random(4)
    values = [0.25, 0.35, 2.675, 0.15, 0.5, 1.5, 2.5, 0.05, 1.005, 0.125, -0.04, -0.35, -2.5, 99.95, 9.995, 123456789.5, 0.0, 999999999999.25, 0.3499999999, 1e14 + 0.5]
    values += [rng.choice([rng.uniform(-10, 10), rng.randrange(4000) / 400, rng.uniform(-1e9, 1e9), rng.randrange(-999, 999) / 1000]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", *[X.fixed(F.col("x"), k).alias(f"p{k}") for k in range(4)], X.fixed(F.col("x"), 3, True).alias("plus"))
    for r in df.collect():
        x = values[r["i"]]
        assert [r[f"p{k}"] for k in range(4)] == [f"{x:.{k}f}" for k in range(4)], x
        assert r["plus"] == f"{x:+.3f}"


def test_details_numbers(spark):
    cases = {"6": "6", "6.0": "6.0", "0.35": "0.3", "1e20": "?", "true": "?", "-3": "-3", "12345678901234567": "?"}
    rows = {r["t"]: r["n"] for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", X.number(F.col("t"), 1).alias("n")).collect()}
    assert rows == cases
    none = spark.createDataFrame([("-0.4",)], "t string").select(X.number(F.col("t")).alias("n")).first()["n"]
    assert none == "0"


def test_sentences(spark):
    details = [
        ({"beeline": {"score": 0.9, "episodes": 7, "null_episodes": 2.25, "moving_minutes": 81.5, "z": 2.65}, "ttc": {"score": 0.2, "median_ttc_s": 599.6, "server_median_ttc_s": 630.0, "episodes": 4, "contacts": 3, "z": 1.0}},
         ["Beeline: 7 walks straight to players out of sight vs 2.2 expected (in 82 min of moving, z 2.6)", "Time to contact: median 600 s after spawning vs 10 min server median (3 contacts in 4 spawns, z 1.0)"]),
        ({"ambush": {"score": 1, "hits": 2, "waits": 3}, "beeline": {"score": 0}, "ttc": {"score": 0.1, "median_ttc_s": -1, "server_median_ttc_s": -1}},
         ["Ambush: 2 of 3 waits ended with a distant player arriving", "Time to contact: no contact after spawning"]),
        ({}, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(details)], "i int, d string")
    for r in df.select("i", X.behaviours(F.col("d")).alias("l")).collect():
        assert r["l"] == details[r["i"]][1]
    line = spark.createDataFrame([(84,)], "n long").select(X.gain_summary(F.lit(21.05), F.lit(0.335), F.lit(-0.0005), F.col("n"), 15.0).alias("l")).first()["l"]
    assert line == f"leakage z {21.05:.1f} (sub-score {0.335:.2f}): players nobody could have seen predict this player's moves {-0.0005:+.3f} nats per move better than the same players at other times, over 84 moves ({84 * 15.0 / 3600:.1f} h observed); too few moves to score (needs 120)"


def test_shapes_and_salvaged_names(spark):
    shape = lambda t: spark.createDataFrame([(t,)], "t string").select(X.line_shape(F.col("t")).alias("s")).first()["s"]
    assert shape("Name: John Smith: hi, PlayerID: 7, Mutation Slots: x") == "Name Smith PlayerID Slots"
    lines = ["UserName x Name: Bob, PlayerID : 76561190000000001 X=1 Y=2 Z=3", "NAME : A: b , PlayerID- 76561190000000002 X=1 Y=2 Z=3", "76561190000000003 X=1 Y=2 Z=3"]
    got = T.parse(spark.createDataFrame([("r", "\n".join(lines))], "response_id string, text string")).orderBy("line_no").collect()
    assert [(r["salvaged"], r["player_name"]) for r in got] == [(True, "Bob"), (True, "A: b"), (True, "")]


def test_what_is_shown_is_worked_out_once(spark):
    text = F.sha2(F.col("id").cast("string"), 256)
    used = lambda c: spark.range(1).select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("sha2(")
    assert [used(c) for c in (X.number(text, 1), X.number(text), X.duration(text), X.fixed(F.length(text).cast("double"), 2), X.behaviours(text))] == [1] * 5
