"""Evidence of a window with leading context, its stages, and records around it."""

import pytest
from pyspark.sql import functions as F

from driftline import queries as Q
from driftline.functions import text as X
from driftline.operators import approach as A
from driftline.operators import evidence as E
from driftline.operators import grid as G
from driftline.operators import records as R
from driftline.operators import relational as Rel
from driftline.operators import window as V
from driftline.operators.state import Table, accumulated, numbered
from driftline.rules import EVENT_RULES as RULES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grid(spark):
    rows = Q.samples(spark, DATA).filter("player_id in ('u1', 'u2', 'u3', 'u4', 'u5', 'u6')")
    return Table(G.headings(G.resample(rows, RULES), RULES)).df


@pytest.fixture(scope="module")
def since(grid):
    return grid.select("server_id", F.expr("n div 2").alias("count_from")).distinct()


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_context_counts_nothing_but_stays_context(grid, since):
    assoc = Table(E.associates(grid, RULES)).df
    late = lambda df, at: df.join(since, "server_id").filter(F.col(at) >= F.col("count_from")).drop("count_from")
    assert rows_of(E.spawn_episodes(grid, assoc, RULES, since)) == rows_of(late(E.spawn_episodes(grid, assoc, RULES), "idx"))
    every = Table(A.episodes(grid, assoc, RULES)).df
    assert rows_of(A.episodes(grid, assoc, RULES, since=since)) == rows_of(late(every, "run_start"))
    moving = {r["player_id"]: r["moving_s"] for r in A.beelines(grid, every, RULES, since).collect()}
    want = late(grid, "idx").groupBy("player_id").agg((F.count_if("moving") * 5.0).alias("s")).collect()
    assert moving == {r["player_id"]: r["s"] for r in want}
    waits = {r["player_id"]: r["waits"] for r in E.ambushes(grid, assoc, RULES, since).collect()}
    count = {r["player_id"]: r["count"] for r in late(E.waits(grid, RULES), "run_start").groupBy("player_id").count().collect()}
    assert waits == {p: count.get(p, 0) for p in waits}


def test_meetups_before_the_count_separate_those_after(spark):
    round_ = [0.0] * 20 + [200.0 * k for k in (*range(1, 9), *range(7, 0, -1))]
    rows = [("s", "a", i, 0.0, 0.0, "c", 300.0, 385) for i in range(385)]
    rows += [("s", "b", i, x, 0.0, "c", 300.0, 385) for i, x in enumerate(round_ * 11)]
    g = spark.createDataFrame(rows, "server_id string, player_id string, idx long, x double, y double, dino_class string, aware double, n long")
    whole = E.meetups(g, RULES).collect()[0]["meets"]
    half = E.meetups(g, RULES, spark.createDataFrame([("s", 175)], "server_id string, count_from long")).collect()[0]["meets"]
    assert (whole, half) == (11, 6)


def test_clanmates_of_earlier_windows_are_no_targets(spark, grid):
    prior = spark.createDataFrame([("u1", "u2", 9, 0.0, 0, 0.0), ("u2", "u3", 9, 0.0, 0, 0.0)], "player_a string, player_b string, meets long, null_meets double, tips long, null_tips double")
    ev = V.extract(grid, RULES, prior_pairs=prior)
    clans = {r["player_id"]: r["clan"] for r in ev.clans.collect()}
    assert {clans["u1"], clans["u2"], clans["u3"]} == {min(clans[p] for p in ("u1", "u2", "u3"))}
    mates = {(r["player_id"], r["player_id_j"]) for r in V.clanmates(grid, ev.clans).collect()}
    assert {("u1", "u2"), ("u2", "u1"), ("u1", "u3")} <= mates
    assert not {("u1", "u2"), ("u2", "u3")} & {(r["player_a"], r["player_b"]) for r in ev.pairs.filter("meets >= 9").collect()}


def test_windows_due(spark):
    progress = spark.createDataFrame([("a", 0.0), ("b", 100_000.0), ("c", None), ("d", 20_000.0)], "org_id string, start double")
    got = sorted(tuple(r) for r in V.pending_windows(progress, RULES, 35_000.0, most=3).collect())
    assert got == [("a", 0.0, 7200.0), ("a", 7200.0, 14400.0), ("a", 14400.0, 21600.0), ("d", 20000.0, 27200.0), ("d", 27200.0, 34400.0)]


def test_close_pairs_equal_all_pairs_within_the_radius(grid):
    place = grid.select("server_id", "idx", "player_id", "x", "y")
    for ordered in (True, False):
        assert rows_of(G.close(place, place, 700.0, ordered)) == rows_of(G.pairs(place, place, ordered).filter(G.square() <= 700.0**2))


def test_places_and_sums_in_order(spark):
    values = [(i * 37 % 101, i % 5) for i in range(200)]
    df = spark.createDataFrame(values, "k long, v long").repartition(5)
    got = sorted((r["n"], r["k"], r["v"]) for r in numbered(df, [F.col("k"), F.col("v")], "n").collect())
    assert [(k, v) for _, k, v in got] == sorted(values) and [n for n, _, _ in got] == list(range(200))
    sums = sorted((r["k"], r["s"]) for r in accumulated(spark.createDataFrame([(i, i * i) for i in range(50)], "k long, v long"), [F.col("k")], "v", "s").collect())
    assert sums == [(i, sum(j * j for j in range(i))) for i in range(50)]
    assert numbered(df.filter("false"), [F.col("k")], "n").collect() == []


def test_token_bucket_streams_keys(spark):
    calls = [(k, float(t)) for k in ("a", "b") for t in (0, 1, 2, 3, 20, 21, 22)]
    got = {}
    for r in Rel.token_bucket(spark.createDataFrame(calls, "k string, at double"), "k", "at", 0.1, 2).collect():
        got.setdefault(r["k"], []).append((r["at"], r["allowed"]))
    want = [(0.0, True), (1.0, True), (2.0, False), (3.0, False), (20.0, True), (21.0, True), (22.0, False)]
    assert {k: sorted(v) for k, v in got.items()} == {"a": want, "b": want}


def test_texts(spark):
    rows = spark.createDataFrame([("a\\\\b" * 9, "x\x07\n"), ("short", None), ("<&'\">", "ok")], "t string, c string")
    out = rows.select(X.truncated(F.col("t"), 7).alias("cut"), X.cleaned(F.col("c")).alias("clean"), X.html_escaped(F.col("t")).alias("html")).collect()
    assert out[0]["cut"].endswith("…") and len(out[0]["cut"]) <= 7 and not out[0]["cut"][:-1].endswith("\\" * 3)
    assert [r["clean"] for r in out] == ["x", "(no name)", "ok"] and out[2]["html"] == "&lt;&amp;&#x27;&quot;&gt;"


def test_seeded_sample_is_stable(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    one, other = ([r["k"] for r in R.drawn(df, ["k"], 20, 3).collect()] for df in (rows, rows.repartition(9)))
    assert one == other and len(set(one)) == 20 and one != [r["k"] for r in R.drawn(rows, ["k"], 20, 4).collect()]
