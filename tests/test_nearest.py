"""Nearest approaches: near pairs settle in small cells, others go on to wider ones."""

from driftline import queries as Q
from driftline.operators import grid as G
from driftline.operators import nearest as N
from driftline.operators import tracks as T
from driftline.rules import EVENT_RULES as R


def test_pairs_of_a_settled_player_are_not_looked_for_further(spark):
    line = lambda p, x: [("s", p, float(x), float(y)) for y in range(0, 3000, 10)]
    rows = spark.createDataFrame([*line("a", 0), *line("b", 1), *line("c", 400), ("s", "nan", float("nan"), 0.0), ("s", "far", 5000.0, 0.0)], "server_id string, player_id string, x double, y double")
    ours = lambda r: (r["player_id"], r["player_id_j"], r["distance2"])
    all_ = {ours(r) for r in T.nearest_approach(rows, rows, 500.0, 8).collect()}
    assert all_ == {(i, j, d) for i, j, d in (("a", "b", 1.0), ("b", "a", 1.0), ("a", "c", 160000.0), ("c", "a", 160000.0), ("b", "c", 159201.0), ("c", "b", 159201.0))}
    assert {ours(r) for r in T.nearest_approach(rows, rows, 500.0, 1).collect()} == {("a", "b", 1.0), ("b", "a", 1.0), ("c", "b", 159201.0)}
    near = T._within(rows, rows, 500.0 / 2 ** (T.ROUNDS - 1), None).collect()
    assert {ours(r) for r in near} == {("a", "b", 1.0), ("b", "a", 1.0)}


def test_pieces_of_tracks_come_as_near_as_their_points(spark, monkeypatch):
    samples = Q.samples(spark, "/root/testdata/sf0.001").filter("player_id in ('u1', 'u2', 'u3', 'u4')")
    grid = G.resample(samples, R)
    content = lambda df: sorted(map(tuple, df.select("server_id", "player_id", "player_id_j", "distance2").collect()))
    want = content(T.nearest_approach(grid, grid, 500.0, 2))
    odd = [(0, 1, 5.0, float("nan"), "c"), (0, 2, float("inf"), 0.0, "c"), (0, 9, 5.0, 1.0, "c")]
    more = samples.unionByName(spark.createDataFrame([("srv-0", "odd", *r[1:]) for r in odd], "server_id string, player_id string, t long, x double, y double, dino_class string"))
    for block, at_once in ((N.BLOCK, N.AT_ONCE), (100, 50)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "AT_ONCE", at_once)
        assert content(N.nearest_approach(G.pieces(samples, R), 500.0, 2)) == want and len(want) == 8
    G_ = G.resample(more, R)
    assert content(N.nearest_approach(G.pieces(more, R), 500.0, 9)) == content(T.nearest_approach(G_, G_, 500.0, 9))
