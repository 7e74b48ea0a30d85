"""Shadow scoring by version, keyed areas under curves, counts that add up, and scans that prune."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import approach as A
from driftline.operators import evidence as E
from driftline.operators import leakage as L
from driftline.operators import shadow as H
from driftline.operators.relational import auc, latest
from driftline.operators.state import accumulated
from driftline.operators.store import Store
from driftline.plans import exports as P
from driftline.rules import Rules
from driftline.sources import export as X

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def gains(spark):
    rng = random.Random(5)
    rows = [(o, p, float(t), rng.gauss(0.3 if p == "p0" else 0.0, 1.0)) for o in ("a", "b") for p in ("p0", "p1") for t in range(0, 500, 5) if not (o == "b" and t >= 300)]
    return spark.createDataFrame(rows, "org_id string, player_id string, t double, gain double")


def stats_of(gains, seen):
    def stats(windows):
        seen.append(sorted((r["org_id"], r["end"]) for r in windows.collect()))
        rows = gains.join(windows, "org_id").filter("t >= start and t < end")
        return L.statistics(rows, ["org_id", "player_id"], ["t"])

    return stats


def test_a_version_scores_the_horizon_once(spark, tmp_path, gains, monkeypatch):
    store, seen = Store(spark, str(tmp_path / "s"), H.SCHEMAS), []
    for end in (100.0, 200.0, 300.0, 400.0, 500.0):
        store.save(f"window-{end:.0f}", {}, {"a": end} | ({"b": end} if end <= 300 else {}))
    run = lambda version, now, most=24: H.run_shadow(store, version, stats_of(gains, seen), now, 100.0, 350.0, most, least=5)
    assert run("v1", 500.0, 3) == (3, 4) and seen == [[("a", 200.0), ("b", 200.0)], [("a", 300.0)]]
    assert run("v1", 501.0) == (3, 4) and run("v1", 502.0) == (0, 0)
    # sums over the horizon are those of the terms, whatever batches they came in
    rows = {(r["org_id"], r["player_id"]): r for r in latest(store.read("leakage_scores"), ["org_id", "player_id", "model_version"], ["computed_at"]).collect()}
    by_window = gains.filter("t >= 100").withColumn("w", F.floor(F.col("t") / 100))
    want = L.summed(L.statistics(by_window, ["org_id", "player_id", "w"], ["t"]), ["org_id", "player_id"]).withColumn("z", L.z()).collect()
    assert {k: (r["moves"], round(r["z"], 9)) for k, r in rows.items()} == {(r["org_id"], r["player_id"]): (r["n"], round(r["z"], 9)) for r in want}
    assert rows["a", "p0"]["summary"].startswith(f"leakage z {rows['a', 'p0']['z']:.1f} (sub-score {rows['a', 'p0']['score']:.2f}): ")
    # a new version starts with the horizon of its day; one that dies before its scores gives them next time
    seen.clear()
    with monkeypatch.context() as m:
        m.setattr(H, "rescore", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run("v2", 600.0)
    assert sorted(w for turn in seen for w in turn) == [("a", 300.0), ("a", 400.0), ("a", 500.0), ("b", 300.0)]
    assert run("v2", 601.0) == (0, 4) and run("v2", 602.0) == (0, 0)
    assert store.read("leakage_scores").groupBy("model_version").count().count() == 2


def test_sums_and_areas_by_key(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", "c", None]), float(rng.randrange(40)), rng.randrange(2)) for _ in range(900)] + [("one", 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, z double, y int").withColumn("v", F.lit(1))
    got = accumulated(df, [F.col("z")], "v", "before", ("k",)).collect()
    for key in {r[0] for r in rows}:
        assert sorted(r["before"] for r in got if r["k"] == key) == list(range(sum(r[0] == key for r in rows)))
    assert sorted(r["before"] for r in accumulated(df, [F.col("z")], "v", "before").collect()) == list(range(901))
    for r in auc(df, "z", "y", ("k",)).collect():
        p, q = ([z for k, z, y in rows if k == r["k"] and y == c] for c in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)) if p and q else None
        assert r["auc"] == (pytest.approx(want) if want is not None else None)


def test_scores_of_added_counts_are_those_of_the_whole(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(9)}", rng.choice(["x", "y", None]), 5.0 * rng.randrange(12), rng.random() < 0.3) for _ in range(200)]
    spawns = spark.createDataFrame(rows, "player_id string, dino_class string, duration_s double, censored boolean")
    parts = [A.spawn_counts(spawns.filter(F.crc32("player_id") % 2 == k)) for k in (0, 1)] + [A.spawn_counts(spawns.limit(0))]
    whole = A.spawn_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    rules = Rules()
    order = lambda df: sorted((r["player_id"], r["episodes"], r["contacts"], round(r["mean_rank"], 9), round(r["score"], 9)) for r in df.collect())
    assert order(A.contact_scores(whole, rules)) == order(A.contact_scores(spawns, rules)) and whole.count() < 200
    assert E.PAIR  # the episodes these counts come from


def test_a_range_reads_its_dates_columns_and_times(spark):
    rows = X.read(spark, P.exported(spark, DATA), "2024-01-08", "2024-01-14", ["t", "x"], 1_704_700_000.0, 1_705_200_000.0)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(date" in scan and ">= 2024-01-08" in scan and "<= 2024-01-14" in scan
    assert "GreaterThanOrEqual(t,1.7047E9)" in scan and "LessThan(t,1.7052E9)" in scan and "ReadSchema: struct<t:double,x:float>" in scan
    assert rows.agg(F.min("t"), F.max("t")).first()[0] >= 1_704_700_000
