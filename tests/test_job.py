"""Batches that show whole or not at all, and the run that is built on them."""

import pytest
from pyspark.sql import functions as F

from driftline import queries as Q
from driftline.functions.scalars import pseudonym
from driftline.operators import grid as G
from driftline.operators import job as J
from driftline.operators import window as V
from driftline.operators.state import Table
from driftline.operators.store import Store
from driftline.rules import EVENT_RULES as RULES

DATA = "/root/testdata/sf0.001"
ROWS = {"t": "k long, v string"}


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS["t"])


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_shows_once_and_whole(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), ROWS)
    assert store.read("t").collect() == [] and store.progress().collect() == []
    assert store.save("one", {"t": frame(spark, (1, "a"))}, {"o": 10.0})
    assert not store.save("one", {"t": frame(spark, (1, "again"))}, {"o": 10.0})
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.save("two", {"t": frame(spark, (2, "lost"))}, {"o": 20.0})
    assert content(store.read("t")) == [(1, "a")] and store.progress().collect()[0]["until"] == 10.0
    assert store.save("two", {"t": frame(spark, (2, "b"))}, {"o": 20.0})
    assert content(store.read("t")) == [(1, "a"), (2, "b")] and content(store.read("t", after=10.0)) == [(2, "b")]
    assert store.vacuum() == 1 and content(store.read("t")) == [(1, "a"), (2, "b")]


def test_of_two_writers_one_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROWS)
    for name in ("x", "y"):
        store._written(frame(spark, (1, name)), "t", f"{store.root}/data/t/b-{name}")
    assert [store._commit("b", n, {"batch": "b", "tables": {"t": f"data/t/b-{n}"}, "ends": {}}) for n in ("x", "y")] == [True, False]
    assert content(store.read("t")) == [(1, "x")]


def cheap(positions, windows, store, rules, context_s, horizon_s):
    """A stand-in for the evidence: who was there, with hits enough to be flagged for one player."""
    if windows.filter("org_id = 'bad' and end > 150").count():
        raise ValueError("a window that can't be worked out")
    rows = positions.join(windows, "org_id").filter("t >= start and t < end").select("org_id", "player_id", F.col("end").alias("window_end")).distinct()
    hot = F.when(F.col("player_id") == "hot", 20).otherwise(0).cast("long")
    evidence = rows.select("*", F.lit("s").alias("servers"), F.lit(900.0).alias("moving_s"), F.lit(0).cast("long").alias("beeline_episodes"), F.lit(0.0).alias("beeline_null"), F.lit(0.0).alias("beeline_start_sum_m"), hot.alias("ambush_waits"), hot.alias("ambush_hits"), F.lit(0.0).alias("ambush_null"))
    empty = windows.limit(0)
    spawns = empty.select("org_id", F.lit("").alias("player_id"), F.col("end").alias("window_end"), F.lit("").alias("dino_class"), F.lit(0.0).alias("duration_s"), F.lit(False).alias("censored"))
    pairs = empty.select("org_id", *[F.lit("").alias(c) for c in ("player_a", "player_b")], F.col("end").alias("window_end"), F.lit(0).cast("long").alias("meets"), F.lit(0.0).alias("null_meets"), F.lit(0).cast("long").alias("tips"), F.lit(0.0).alias("null_tips"))
    return {"evidence": evidence, "spawns": spawns, "pairs": pairs}


@pytest.fixture(scope="module")
def positions(spark):
    rows = [(o, "s", p, float(t), 1.0, 2.0, "c") for o in ("a", "bad", "c") for p in ("hot", "cold") for t in range(0, 400, 50)]
    return spark.createDataFrame(rows, "org_id string, server_id string, player_id string, t double, x double, y double, dino_class string")


def run(store, positions, now, **more):
    rows = J.run_scoring(store, positions, RULES, now, lag_s=0.0, window_s=100.0, horizon_s=1e6, evidence=cheap, **more)
    return {r["org_id"]: (r["windows"], r["scored"], r["new_flags"]) for r in rows.collect()}


def state(store):
    return {t: content(store.read(t)) for t in J.SCHEMAS}


def test_a_run_saves_scores_and_flags(spark, tmp_path, positions, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), J.SCHEMAS)
    assert run(store, positions, 250.0) == {"a": (2, 2, 1), "bad": (1, 2, 1), "c": (2, 2, 1)}
    assert {r["org_id"]: r["until"] for r in store.progress("window-").collect()} == {"a": 200.0, "bad": 100.0, "c": 200.0}
    before = state(store)
    assert len(before["alerts"]) == 3 and len(before["evidence"]) == 10
    assert run(store, positions, 250.0) == {} and state(store) == before
    # dies between the windows and the scores: the next run scores what is there
    with monkeypatch.context() as m:
        m.setattr(J, "score_and_flag", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run(store, positions, 350.0)
    assert len(store.read("scores").collect()) == len(before["scores"])
    run(store, positions, 351.0)
    scores = store.read("scores").filter("computed_at = 351").collect()
    assert {(r["org_id"], r["player_id"]) for r in scores} == {(o, p) for o in ("a", "c") for p in ("hot", "cold")}
    flags = Q.Q.latest(store.read("flags"), ["org_id", "player_id", "created_at"], ["updated_at"])
    assert {(r["org_id"], r["created_at"], r["updated_at"]) for r in flags.collect()} == {("a", 250.0, 351.0), ("bad", 250.0, 250.0), ("c", 250.0, 351.0)}
    assert J.resolve(store, flags.filter("org_id = 'a'"), "false_positive", 360.0)
    run(store, positions, 400.0)
    assert len(store.read("alerts").collect()) == 3
    last = {r["org_id"]: (r["status"], r["updated_at"]) for r in Q.Q.latest(store.read("flags"), ["org_id", "player_id", "created_at"], ["updated_at"]).collect()}
    assert last == {"a": ("false_positive", 360.0), "bad": ("open", 250.0), "c": ("open", 400.0)}


def test_exports_go_on_past_a_window_that_fails(spark, tmp_path, positions, monkeypatch):
    store, target = Store(spark, str(tmp_path / "s"), J.SCHEMAS), Store(spark, str(tmp_path / "x"), J.EXPORTED)
    run(store, positions.filter("org_id <> 'bad'"), 200.0)
    whole, key = J.export_window, b"k" * 32
    with monkeypatch.context() as m:
        m.setattr(J, "export_window", lambda *a: whole(*a) if a[4:6] != ("a", 200.0) else 1 / 0)
        assert J.export_pending(store, target, positions, key, RULES, 100.0) == (3, 1)
    assert J.export_pending(store, target, positions, key, RULES, 100.0) == (1, 0)
    assert J.export_pending(store, target, positions, key, RULES, 100.0) == (0, 0)
    hidden = {r[0] for r in spark.range(1).select(F.explode(F.array(*[pseudonym("player", F.lit(p), key) for p in ("hot", "cold")]))).collect()}
    rows = target.read("evidence").collect()
    assert len(rows) == 8 and {r["player"] for r in rows} == hidden and {r["clan"] for r in rows} == {-1}
    assert target.read("positions").count() == 16 and {(r["rows"], r["players"], r["servers"]) for r in target.read("windows").collect()} == {(4, 2, 1)}


def test_evidence_of_a_run_is_that_of_its_windows(spark, tmp_path):
    some = Q.samples(spark, DATA).filter("player_id in ('u1', 'u2', 'u3', 'u4')").withColumn("org_id", F.lit("o"))
    some = Table(some.withColumn("t", F.col("t").cast("double"))).df
    start = some.agg(F.min("t")).first()[0]
    store = Store(spark, str(tmp_path / "s"), J.SCHEMAS)
    windows = spark.createDataFrame([("o", start + 2000.0, start + 5000.0)], "org_id string, start double, end double")
    store.save("window-x", J.window_evidence(some, windows, store, RULES, context_s=1000.0), {"o": start + 5000.0})
    rows = some.filter((F.col("t") >= start + 1000) & (F.col("t") < start + 5000)).drop("org_id")
    grid = Table(G.headings(G.resample(rows, RULES), RULES)).df
    ev = V.extract(grid, RULES, G.counted_from(rows, start + 2000.0, RULES))
    want = {r["player_id"]: (r["moving_s"], r["episodes"], r["waits"]) for r in ev.players.join(ev.beeline, ["server_id", "player_id"]).join(ev.ambush, ["server_id", "player_id"]).collect()}
    got = {r["player_id"]: (r["moving_s"], r["beeline_episodes"], r["ambush_waits"]) for r in store.read("evidence").collect()}
    assert got == want and any(v[0] for v in want.values())
    assert {(r["player_id"], r["duration_s"]) for r in store.read("spawns").collect()} == {(r["player_id"], r["duration_s"]) for r in ev.spawns.collect()}


def test_evaluation_folds_windows(spark, tmp_path, positions):
    def half(positions, windows, *rest):
        """Hits of one player in the second window on, and meetings of a and b in every window."""
        out = cheap(positions, windows, *rest)
        late = F.col("window_end") > 150
        out["evidence"] = out["evidence"].withColumns({c: F.when(late, F.col(c)).otherwise(0).cast("long") for c in ("ambush_waits", "ambush_hits")})
        pairs = windows.select("org_id", F.lit("cold").alias("player_a"), F.lit("hot").alias("player_b"), F.col("end").alias("window_end"), F.lit(4).cast("long").alias("meets"), F.lit(0.0).alias("null_meets"), F.lit(0).cast("long").alias("tips"), F.lit(0.0).alias("null_tips"))
        return out | {"pairs": pairs}

    store = Store(spark, str(tmp_path / "s"), J.SCHEMAS)
    teams = spark.createDataFrame([("a", "cold", "hot"), ("c", "cold", "other")], "org_id string, player_a string, player_b string")
    scores, quality = J.evaluate(store, positions.filter("org_id <> 'bad'"), RULES, 100.0, 0.0, teams, evidence=half)
    got = {(r["org_id"], r["player_id"], r["part"]): r["flagged"] for r in scores.collect()}
    assert got == {(o, p, part): p == "hot" and part == "accumulated" for o in "ac" for p in ("hot", "cold") for part in ("first", "accumulated")}
    assert tuple(quality.first())[:3] == (1, 2, 2)


def test_a_window_that_fails_is_no_result(spark, tmp_path, positions):
    with pytest.raises(RuntimeError, match="bad to 200.0"):
        J.evaluate(Store(spark, str(tmp_path / "s"), J.SCHEMAS), positions, RULES, 100.0, 0.0, evidence=cheap)
    store = Store(spark, str(tmp_path / "r"), J.SCHEMAS)
    with pytest.raises(RuntimeError, match="1 windows failed: bad to 200.0"):
        run(store, positions, 250.0, strict=True)
    assert {r["org_id"]: r["until"] for r in store.progress("scores-").collect()} == {"a": 200.0, "bad": 100.0, "c": 200.0}
