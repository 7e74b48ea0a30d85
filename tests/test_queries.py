"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from driftline import plans as Q

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    frame = Q.QUERIES[name](spark, DATA)
    got = [tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()]
    result = duck.sql(Q.SQL[name])
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    want = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(frame.columns) == sorted(result.columns)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="session")
def few(spark, tmp_path_factory):
    """A folder with the events of four players whose ids don't end in 0, and their grid."""
    folder = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet(f"{DATA}/events.parquet").filter("user_id in (1, 2, 3, 4) and event_id % 3 = 0").write.parquet(f"{folder}/events.parquet")
    tracks = {}
    for r in Q.QUERIES["w1_resample"](spark, folder).collect():
        tracks.setdefault((r["server_id"], r["player_id"]), {})[r["idx"]] = (r["x"], r["y"])
    return folder, tracks


def test_nearest_approach_takes_every_point_and_player(spark, few):
    folder, tracks = few
    want = {}
    for a, mine in tracks.items():
        for b, others in tracks.items():
            if a[0] == b[0] and a != b:
                least = min((u - x) * (u - x) + (v - y) * (v - y) for x, y in set(mine.values()) for u, v in set(others.values()))
                if least <= 250000:
                    want[(*a, b[1])] = least
    got = Q.QUERIES["j11_nearest_approach"](spark, folder).collect()
    assert {r["player_id"] for r in got} == {p for _, p in tracks} and want
    assert {(r["server_id"], r["player_id"], r["player_id_j"]): r["distance2"] for r in got} == want and len(got) == len(want)


def test_tracking_has_every_moving_step(spark, few):
    folder, tracks = few
    want = set()
    for (server, player), mine in tracks.items():
        others = [t for (s, p), t in tracks.items() if s == server and p != player]
        for idx, (x, y) in mine.items():
            ahead = mine.get(idx + 3)
            if ahead and (ahead[0] - x) ** 2 + (ahead[1] - y) ** 2 >= 506.25 and any(idx in t for t in others):
                want.add((server, player, idx))
    got = [(r["server_id"], r["player_id"], r["idx"]) for r in Q.QUERIES["w18_tracking"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and any(idx % 12 for _, _, idx in want)
