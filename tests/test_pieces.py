"""Steps that are near each other are found from the pieces of tracks, without dealing the grid anew."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import evidence as E
from driftline.operators import grid as G
from driftline.operators import job as J
from driftline.operators import tracks as T
from driftline.operators import window as V
from driftline.rules import Rules

RULES = Rules(null_shifts_s=(100.0, 200.0), meet_min_s=20.0, associate_min_s=50.0, meet_radius_m=200.0, apart_m=260.0, fight_grace_s=10.0)


@pytest.fixture(scope="module")
def samples(spark):
    rnd, rows = random.Random(5), []
    for s in ("s", "u"):
        for p in range(7):
            t, x, y = rnd.randint(0, 9), rnd.uniform(0, 600), rnd.uniform(0, 600)
            while t < 1500:
                rows.append((s, f"p{p}", float(t), x, y, "a"))
                t, x, y = t + rnd.choice((7, 11, 25, 25, 25, 25, 25, 40)), x + rnd.uniform(-90, 90), y + rnd.uniform(-90, 90)
                x, y = min(700.0, max(0.0, x)), min(700.0, max(0.0, y))
    return spark.createDataFrame(rows, "server_id string, player_id string, t double, x double, y double, dino_class string")


def steps(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_near_and_meetups_equal_those_of_single_steps(spark, samples):
    pieces, grid = G.pieces(samples, RULES), G.resample(samples, RULES)
    near = rows(E.near(None, RULES, pieces))
    assert near and near == rows(E.near(grid, RULES))
    met = rows(E.meetups(None, RULES, tracks=pieces.kept()))
    assert any(m[3] for m in met) and any(m[4] for m in met)
    assert met == rows(E.meetups(grid, RULES))


def test_shifted_pieces_are_shifted_steps(spark, samples):
    pieces = G.pieces(samples, RULES)
    columns = ["server_id", "player_id", "shift", "idx", "x", "y"]
    moved = G._as_steps(pieces.shifted(), RULES, "shift")
    assert rows(moved.select(columns)) == rows(G.shifted(G.resample(samples, RULES), RULES, real=False).select(columns))


def test_nothing_as_long_as_the_grid_is_shuffled_for_neighbours(spark, samples):
    pieces = G.pieces(samples, RULES)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (T.nearest_slots(pieces.dealt_steps(), 3, 200.0), pieces.steps().groupBy("server_id", "player_id").count()):
            plan = steps(frame)
            assert "Exchange" not in plan.split("Generate explode(sequence")[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_windows_find_meetings_from_pieces(spark, samples, monkeypatch):
    windows = spark.createDataFrame([("o", 500.0, 1500.0)], "org_id string, start double, end double")
    grid, since, pieces = J.window_grid(samples.withColumn("org_id", F.lit("o")), windows, RULES, 500.0)
    assoc = E.associates(grid, RULES)
    want = rows(V.pair_evidence(grid, assoc, RULES, since))
    monkeypatch.setattr(E, "of_grid", None)
    assert any(r[2] for r in want) and rows(V.extract(grid, RULES, since, tracks=pieces).pairs) == want
