"""Runs of heading for someone, made in blocks of steps, against plain Python on the grid; and what they shuffle."""

import math

import pytest
from pyspark.sql import functions as F

from driftline import queries as Q
from driftline.operators import approach as A
from driftline.operators import evidence as E
from driftline.operators import grid as G
from driftline.operators import heading as H
from driftline.rules import EVENT_RULES as R

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few(spark):
    return Q.samples(spark, DATA).filter("player_id in ('u1', 'u2', 'u3', 'u4', 'u5', 'u6')").localCheckpoint()


def plain(rows):
    """{(shift, i, j, start): (end, d0, arrival or None)} of the runs that begin out of range and last."""
    n, at = rows[0]["n"], {}
    for r in rows:
        at.setdefault(r["player_id"], {})[r["idx"]] = r
    out = {}
    for shift in (0, 120, 240, 360):
        for i, mine in at.items():
            for j, theirs in at.items():
                if i == j:
                    continue
                d = {t: ((q["x"] - p["x"]), (q["y"] - p["y"])) for t, p in mine.items() if (q := theirs.get((t - shift) % n))}
                steps = [t for t in sorted(d) if mine[t]["moving"] and (s := d[t][0] ** 2 + d[t][1] ** 2) > 0 and d[t][0] * mine[t]["dx"] + d[t][1] * mine[t]["dy"] >= R.aligned_cos * math.sqrt(s * (mine[t]["dx"] ** 2 + mine[t]["dy"] ** 2))]
                runs = []
                for t in steps:
                    if runs and t - runs[-1][1] - 1 <= 3:
                        runs[-1][1] = t
                    else:
                        runs.append([t, t])
                square = lambda t: d[t][0] * d[t][0] + d[t][1] * d[t][1]
                for a, b in runs:
                    if b - a + 1 >= 12 and mine[a]["aware"] ** 2 < square(a) <= R.max_start_m**2:
                        far = sum(t in d and square(t) > mine[t]["aware"] ** 2 for t in range(a, b + 1))
                        came = [t for t in range(a, b + 4) if t in d and square(t) <= R.arrive_m**2]
                        out[shift, i, j, a] = (b, square(a), came[0] if came and far >= 12 else None)
    return out


@pytest.mark.parametrize("block", [H.BLOCK, 16])
def test_runs_made_in_blocks_are_those_of_the_grid(spark, few, block, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", block)
    want = plain(G.headings(G.resample(few, R), R).collect())
    for tracks in (G.pieces(few, R).kept(), G.of_grid(G.resample(few, R), R).kept()):
        got = {(r["shift"], r["player_id"], r["player_id_j"], r["run_start"]): r for r in A.runs_of(tracks, R).collect()}
        assert got and all((r["run_end"], r["d0"]) == want[k][:2] for k, r in got.items())
        assert {k: r["arrival"] for k, r in got.items() if r["whole"]} == {k: v[2] for k, v in want.items() if v[2] is not None and not (k in got and not got[k]["whole"])}
        assert all(k in got for k, v in want.items() if v[2] is not None)


def test_approaches_need_no_grid(spark, few):
    grid, tracks = G.headings(G.resample(few, R), R), G.pieces(few, R).kept()
    assoc = E.associates(None, R, E.near(None, R, tracks))
    content = lambda df: sorted(map(tuple, df.collect()))
    clans = spark.createDataFrame([("u1", "u1"), ("u2", "u1"), ("u3", "u3")], "player_id string, clan string")
    for more in ({}, {"clans": clans}):
        assert content(A.episodes(None, assoc, R, tracks=tracks, **more)) == content(A.episodes(grid, assoc, R, **more)) != []
    assert content(A.tips(None, assoc, R, tracks=tracks)) == content(A.tips(grid, assoc, R))
    assert content(E.ambushes(None, assoc, R, tracks=tracks)) == content(E.ambushes(grid, assoc, R))
    since = grid.select("server_id", F.expr("n div 2").alias("count_from")).distinct()
    assert content(A.beelines(None, A.episodes(None, assoc, R, tracks=tracks), R, since, tracks)) == content(A.beelines(grid, A.episodes(grid, assoc, R), R, since))


def test_who_dies_is_found_from_the_falls(spark, few):
    grid = G.resample(few, R)
    want = {(r["player_id"], r["idx"]) for r in G.deaths(grid, R).filter("died").collect()}
    rows = grid.select("server_id", "player_id", "idx")
    got = G.who_dies(rows, G.falls(grid, R), R, "player_id", "idx", ["player_id", "idx"]).collect()
    assert {tuple(r) for r in got} == want and 0 < len(want) < grid.count()
