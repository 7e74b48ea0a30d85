"""Queries around the move models, on samples made from events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import leakage as M
from ..operators import learning as L
from ..operators import shadow as H
from ..operators.relational import latest
from ..operators.state import Table, shared_folder
from ..operators.store import Store
from ..queries import events, on_events, query
from ..sources.profiles import resolved, with_awareness

#: Classes of the events table; "shop" extends "base".
PROFILES = {"base": {"name": "base", "defaults": {"sight_m": 300, "scent_m": 200}, "classes": {"view": {"scent_m": 450}, "error": {"sight_m": 100}}}, "shop": {"name": "shop", "extends": "base", "classes": {"purchase": {"sight_m": 900}, "error": {"scent_m": 50}}}}


@query(on_events("SELECT event_id, event_type, CASE event_type WHEN 'purchase' THEN 900.0::DOUBLE WHEN 'view' THEN 450.0::DOUBLE WHEN 'error' THEN 100.0::DOUBLE ELSE 300.0::DOUBLE END AS aware FROM e"))
def p8_profile_awareness(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("dino_class"))
    return with_awareness(rows, resolved(PROFILES, "shop")).select("event_id", F.col("dino_class").alias("event_type"), "aware")


FOLD = "CAST(CAST('0x' || substr(sha256('{salt}:' || {of}), 1, 16) AS UBIGINT) % {n} AS INTEGER)"


@query(on_events(f"SELECT event_id, player_id, synthetic, {FOLD.format(salt='fold', of='source', n=3)} AS fold, {FOLD.format(salt='valid', of='source', n=7)} = 0 AS valid FROM (SELECT event_id, 'u' || user_id AS player_id, 'u' || user_id AS source, false AS synthetic FROM e UNION ALL SELECT event_id, 'u' || user_id || '#esp', 'u' || user_id, true FROM e WHERE {FOLD.format(salt='synthetic', of=chr(39) + 'u' + chr(39) + ' || user_id', n=7)} = 0)"))
def l11_training_set(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.concat(F.lit("u"), "user_id").alias("player_id"))
    return L.training_set(rows, rows)


@query(on_events("SELECT round(f - 2.4, 6) AS z_floor, round(f + 1.6, 6) AS z_full FROM (SELECT greatest(5.0::DOUBLE, max(z) + 0.001) AS f FROM (SELECT value / 10 AS z, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM e WHERE event_id % 5 > 0) WHERE r = ceil(0.995 * (n - 1)))"))
def l8_calibration(spark, sf_dir):
    stats = events(spark, sf_dir).select((F.col("value") / 10).alias("z"), F.when(F.col("event_id") % 5 > 0, 500).otherwise(10).alias("n"))
    return L.calibration(stats).select(F.round("z_floor", 6).alias("z_floor"), F.round("z_full", 6).alias("z_full"))


@query(on_events("SELECT event_id, list_filter([CASE WHEN event_id % 7 / 7.0 < 0.7 THEN 'synthetic auc' END, CASE WHEN event_id % 3 = 0 THEN 'honest flagged' END, CASE WHEN value / 100 < 0.85 THEN 'simulator auc' END, CASE WHEN event_id % 2 / 100.0 > 0.005 THEN 'flag rate' END], lambda x: x IS NOT NULL) AS failures FROM e"))
def l9_gate(spark, sf_dir):
    n, none = F.col("event_id"), F.lit(None).cast("double")
    rows = events(spark, sf_dir).select("event_id", (n % 7 / 7.0).alias("synthetic_auc"), (n % 3 == 0).cast("int").alias("honest_flagged"), (F.col("value") / 100).alias("gated_auc"), (n % 2 / 100.0).alias("real_flag_rate"), F.lit(0.0).alias("honest_max_z"), none.alias("current_synthetic_auc"), none.alias("current_gated_auc"), none.alias("current_honest_max_z"))
    return rows.select("event_id", L.failures().alias("failures"))


STATS_SQL = """b AS (SELECT user_id, w, (r - 1) // 8 AS k, count(*) AS m, sum(gain) AS g, sum(gain * gain) AS q FROM g GROUP BY ALL),
t AS (SELECT user_id, CAST(sum(m) AS BIGINT) AS n, count(*) AS blocks, sum(g) AS s, sum(q) AS q, sum(g * g) AS gg, sum(g * m) AS gm, sum(m * m) AS mm, sum(g) / sum(m) AS mean FROM b GROUP BY user_id),
v AS (SELECT *, sqrt(greatest(CASE WHEN blocks > 1 THEN greatest(gg - 2 * mean * gm + mean * mean * mm, 0) * blocks / (blocks - 1) END, greatest(q - n * mean * mean, 0) * n / greatest(n - 1, 1))) AS sd FROM t),
z AS (SELECT *, CASE WHEN blocks < 2 OR sd <= 0 THEN 0 ELSE s / sd END AS z FROM v)"""


@query(on_events("SELECT user_id AS player_id, n AS moves, round(z, 6) AS z, round(CASE WHEN n < 5 THEN 0 ELSE least(1, greatest(0, z / 2)) END, 6) AS score FROM z", "g AS (SELECT user_id, s // 86400 AS w, value / 50 - 1 AS gain, row_number() OVER (PARTITION BY user_id, s // 86400 ORDER BY s, event_id) AS r FROM e WHERE s // 86400 > (SELECT max(s // 86400) FROM e) - 5)", STATS_SQL))
def x25_shadow_scores(spark, sf_dir):
    """A version's first run: the days of the horizon are its windows, and their statistics add up to scores."""
    e = Table(events(spark, sf_dir).withColumn("gain", F.col("value") / 50 - 1)).df
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", H.SCHEMAS)
    store.scratch()
    ends = [r["end"] for r in e.select(((F.expr("s div 86400") + 1) * 86_400.0).alias("end")).distinct().collect()]
    for end in ends:
        store.save(f"window-{end:.0f}", {}, {"o": end})

    def stats(windows):
        rows = e.join(windows, (F.col("s") >= F.col("start")) & (F.col("s") < F.col("end"))).withColumn("player_id", F.col("user_id").cast("string"))
        return M.statistics(rows, ["org_id", "player_id"], ["s", "event_id"])

    H.run_shadow(store, "v1", stats, max(ends, default=0.0), 86_400.0, 5 * 86_400.0, z_floor=0.0, z_full=2.0, least=5)
    rows = latest(store.read("leakage_scores"), ["org_id", "player_id", "model_version"], ["computed_at"])
    return rows.select(F.col("player_id").cast("long").alias("player_id"), "moves", F.round("z", 6).alias("z"), F.round("score", 6).alias("score"))


@query(on_events("""SELECT k.kind, n, round(mean_z, 6) AS mean_z, round(max_z, 6) AS max_z, round(max_score, 6) AS max_score, flagged, round(auc, 6) AS auc FROM k LEFT JOIN (SELECT c.kind, avg(CASE WHEN c.z > h.z THEN 1 WHEN c.z = h.z THEN 0.5 ELSE 0 END) AS auc FROM p c, p h WHERE c.kind IN ('error', 'purchase') AND h.kind IN ('click', 'view') GROUP BY 1) a USING (kind)""",
    "p AS (SELECT event_type AS kind, round(value / 10, 1) AS z, value / 100 AS score FROM e WHERE event_id % 50 >= 5)",
    "q AS (SELECT * FROM p UNION ALL SELECT 'honest', z, score FROM p WHERE kind IN ('click', 'view'))",
    "k AS (SELECT kind, count(*) AS n, avg(z) AS mean_z, max(z) AS max_z, max(score) AS max_score, count(*) FILTER (score >= 0.6) AS flagged FROM q GROUP BY 1)"))
def x26_benchmark(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("kind"), (F.col("event_id") % 50).alias("n"), F.round(F.col("value") / 10, 1).alias("z"), (F.col("value") / 100).alias("score"))
    out = L.benchmark(rows, ["click", "view"], ["error", "purchase"], 0.6, 5)
    return out.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("mean_z", "max_z", "max_score")], "flagged", F.round("auc", 6).alias("auc"))
