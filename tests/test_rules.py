"""Small worlds whose outcome is known."""

import datetime

import pytest
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import approach as A
from driftline.operators import evidence as E
from driftline.operators import grid as G
from driftline.operators import relational as Q
from driftline.rules import Rules
from driftline.sources.text import parse

R = Rules(null_shifts_s=(300.0,), near_s=60.0)


def track(player, points, kind="c"):
    """Samples every five seconds along straight lines between (t, x, y)."""
    rows = []
    for (t0, x0, y0), (t1, x1, y1) in zip(points, points[1:]):
        for t in range(t0, t1, 5):
            f = (t - t0) / (t1 - t0)
            rows.append(("s", player, t, x0 + f * (x1 - x0), y0 + f * (y1 - y0), kind))
    t, x, y = points[-1]
    return rows + [("s", player, t, float(x), float(y), kind)]


def world(spark, *tracks, rules=R):
    rows = [(s, p, t, float(x), float(y), k) for tr in tracks for s, p, t, x, y, k in tr]
    return G.resample(spark.createDataFrame(rows, "server_id string, player_id string, t long, x double, y double, dino_class string"), rules)


def test_resample_cuts_gaps(spark):
    rows = [("s", "a", t, float(t), 0.0, "c") for t in (0, 10, 100)]
    g = G.resample(spark.createDataFrame(rows, "server_id string, player_id string, t long, x double, y double, dino_class string"), R)
    assert {r["idx"]: r["x"] for r in g.collect()} == {0: 0.0, 1: 5.0, 2: 10.0, 20: 100.0}


def episodes(spark, *tracks):
    g = world(spark, *tracks)
    found = A.episodes(g, E.associates(g, R), R)
    return {r["player_id"]: (r["episodes"], r["null_episodes"]) for r in A.beelines(g, found, R).collect()}


def test_pursuit_of_a_moving_target_counts(spark):
    hunter = track("h", [(0, 0, 0), (200, 0, 0), (500, 0, 2400), (900, 0, 2450)])
    target = track("t", [(0, 0, 1500), (200, 0, 1500), (500, 0, 2600), (900, 900, 2600)])
    assert episodes(spark, hunter, target)["h"][0] == 1


def test_head_on_meeting_does_not(spark):
    a = track("a", [(0, 0, 0), (300, 0, 0), (700, 0, 1400), (900, 0, 1400)])
    b = track("b", [(0, 0, 2000), (300, 0, 2000), (700, 0, 600), (900, 0, 600)])
    assert episodes(spark, a, b)["a"][0] == 0


def test_meetups_need_time_apart(spark):
    still = track("a", [(0, 0, 0), (3600, 0, 0)])
    visitor = track("b", [(0, 1000, 0), (300, 0, 10), (500, 0, 10), (800, 1000, 0), (1200, 1000, 0), (1500, 0, 10), (1700, 0, 10), (2000, 300, 0), (2300, 0, 10), (2600, 0, 10), (3600, 1000, 0)])
    row = E.meetups(world(spark, still, visitor), R).first()
    assert (row["player_a"], row["player_b"], row["meets"]) == ("a", "b", 2)


def test_ambush_needs_a_death(spark):
    waiter = track("w", [(0, 0, 0), (1800, 0, 0)])
    passer = track("p", [(0, 900, 0), (600, 900, 0), (900, 10, 0)])
    rows = E.ambushes(world(spark, waiter, passer), spark.createDataFrame([], "server_id string, player_id string, player_id_j string"), R)
    got = {r["player_id"]: (r["waits"], r["hits"]) for r in rows.collect()}
    assert got["w"] == (1, 1)


def test_spawn_contact_and_teleport(spark):
    other = track("o", [(0, 0, 0), (900, 0, 0)])
    late = track("l", [(100, 200, 0), (200, 0, 0), (400, 0, 0)]) + track("l", [(405, 5000, 0), (900, 5000, 0)])
    got = sorted((r["duration_s"], r["censored"]) for r in E.spawn_episodes(world(spark, other, late), spark.createDataFrame([], "server_id string, player_id string, player_id_j string"), R).filter("player_id = 'l'").collect())
    assert len(got) == 2 and got[0][1] is False and got[1] == (500.0, True)


def test_clans_are_components(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "player_a string, player_b string")
    assert {r["player_id"]: r["clan"] for r in A.clans(links).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_score_algebra(spark):
    df = spark.createDataFrame([(9.0, 3.0), (10.0, 0.0)], "o double, e double").select(S.count_z(F.col("o"), F.col("e")).alias("z"))
    assert [r["z"] for r in df.collect()] == [3.0, 10.0]
    one = spark.range(1).select(S.ramp(F.lit(5.0), 3, 7).alias("r"), S.noisy_or((1.0, F.lit(0.5)), (0.9, F.lit(None).cast("double"))).alias("n")).first()
    assert one["r"] == 0.5 and one["n"] == pytest.approx(0.5)


def test_token_bucket(spark):
    calls = spark.createDataFrame([("k", t) for t in (0, 0, 0, 10)], "k string, t long")
    assert [r["allowed"] for r in Q.token_bucket(calls, "k", "t", 0.1, 2).orderBy("at").collect()].count(True) == 3


def test_rejoin_gap_is_inclusive(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 599), ("a", 1199)], "p string, t long")
    assert [r["t"] for r in Q.rejoins(rows, ["p"], "t", 600).orderBy("t").collect()] == [0, 1199]


def test_parser_cases(spark):
    sid = "76561190000000001"
    texts = {
        1: "[2026.01.02-03.04.05] PlayerDataName: A, b, PlayerID: p1, Location: X=1 Y=2 Z=3, Class: BP_Rex_C, Growth: 50%\nPlayerDataEnd\nName: no",
        2: f"Name: x, PlayerID: {sid}, Place: X=1 Y=2 Z=3\r\nName: y, PlayerID: p2, Location: (X=1, Y=2, Z=3), Growth: 1.5\nName: y, PlayerID: p2, Location: X=1 Y=2 Z=3",
        3: "",
        4: None,
        5: "Name: z, PlayerID: bad id, Location: X=1 Y=2 Z=3\ngarbage",
    }
    rows = parse(spark.createDataFrame(list(texts.items()), "response_id long, text string")).orderBy("response_id", "line_no").collect()
    got = [(r["response_id"], r["player_id"], r["player_name"], r["x"], r["dino_class"], r["growth"], r["reason"], r["salvaged"]) for r in rows]
    assert got[0] == (1, "p1", "A, b", 1.0, "Rex", 0.5, None, False)
    assert rows[0]["header_ts"] == datetime.datetime(2026, 1, 2, 3, 4, 5)
    assert got[1] == (2, sid, "x", 1.0, None, None, "no location", True)
    assert got[2][1:7] == ("p2", "y", 1.0, None, None, None)
    assert got[3][6] == "duplicate id" and got[4][6] == "bad id" and got[5][6] == "no name"
    assert len(got) == 6
