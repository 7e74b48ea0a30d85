"""Shadow scoring: a version of the move models scores the windows of the horizon that it hasn't scored yet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import gain_summary
from ..rules import Rules
from . import approach as A
from . import evidence as E
from . import leakage as L
from . import window as V
from .job import SEPARATOR, bare, org_of, qualified, window_grid
from .samples import build_samples
from .selection import Pair
from .state import scope
from .store import Store

STATS = ", ".join(f"{c} double" for c in L.STATS[2:])
SCHEMAS = {
    "leakage": f"org_id string, player_id string, model_version string, window_end double, n long, blocks long, {STATS}",
    "leakage_scores": "org_id string, player_id string, model_version string, computed_at double, z double, score double, moves long, hours double, summary string",
}
WINDOW = "org_id string, start double, end double"


def window_stats(pair: Pair, store: Store, positions: DataFrame, windows: DataFrame, rules: Rules, context_s: float, horizon_s: float) -> DataFrame:
    """(org_id, player_id, the additive statistics) of one window of each org, under the clans of the horizon up to its end."""
    grid, since, tracks = window_grid(positions, windows, rules, context_s)
    ends = windows.select("org_id", "end")
    known = store.read("pairs").join(ends, "org_id").filter((F.col("window_end") > F.col("end") - horizon_s) & (F.col("window_end") <= F.col("end")))
    known = known.select(*[qualified(F.col("org_id"), F.col(c)).alias(c) for c in ("player_a", "player_b")], *V.PAIR_COUNTS)
    clans = A.clans(A.clan_links(V.added(known), rules))
    friends = E.associates(grid, rules, E.near(grid, rules, tracks)).unionByName(V.clanmates(grid, clans)).distinct()
    gains = pair.terms(build_samples(grid, friends, rules, pair.spec, clans, since))
    stats = L.summed(L.statistics(gains, ["player_id", "server_id"], ["idx"]), ["player_id"])
    return stats.withColumn("org_id", org_of("player_id")).withColumn("player_id", bare("player_id"))


def run_shadow(store: Store, version: str, stats: Callable[[DataFrame], DataFrame], now: float, window_s: float = 7200.0, horizon_s: float = 7 * 86_400.0, most: int = 24, z_floor: float = 3.0, z_full: float = 7.0, least: int = 120, stride_s: float = 15.0) -> tuple[int, int]:
    """Scores the windows of the horizon that this version hasn't, oldest first, at most `most`; (windows, players).

    stats(windows) gives the additive statistics of windows (org_id, start, end); the k-th ones of all orgs are one batch.
    What is kept is each window's statistics: a player's score is that of their sum over the horizon, for the players whose
    sums have changed. A new version starts with the horizon, not with history. A run that dies leaves whole windows, and
    the next one scores their players too.
    """
    if SEPARATOR in version or "@" in version:
        raise ValueError("a version is a plain name")
    own, spark = f"leak-{version}@", store.spark
    saved = lambda kind: store.markers().filter(F.col("batch").startswith(kind)).select(F.explode("ends").alias("org_id", "end"))
    done = saved(own).withColumn("model_version", F.lit(version))
    windows = saved("window-").filter(F.col("end") > now - horizon_s)
    due: dict[str, list[float]] = {}
    for r in L.pending(windows, done, version, ["end", "org_id"], most).collect():
        due.setdefault(r["org_id"], []).append(r["end"])
    count = 0
    while turn := sorted((org, ends.pop(0)) for org, ends in due.items() if ends):
        ends = spark.createDataFrame(turn, "org_id string, window_end double")
        name = hashlib.sha256(repr(turn).encode()).hexdigest()
        with scope():
            rows = stats(spark.createDataFrame([(org, end - window_s, end) for org, end in turn], WINDOW))
            count += len(turn) * store.save(f"{own}{name}", {"leakage": rows.join(ends, "org_id").withColumn("model_version", F.lit(version))}, dict(turn))
    return count, rescore(store, version, now, horizon_s, z_floor, z_full, least, stride_s)


def totals(store: Store, version: str, now: float, horizon_s: float) -> DataFrame:
    """(org_id, player_id, the statistics): summed over the windows of the horizon that this version has scored."""
    rows = store.read("leakage", now - horizon_s).filter((F.col("model_version") == version) & (F.col("window_end") > now - horizon_s))
    return L.summed(rows, ["org_id", "player_id"])


def rescore(store: Store, version: str, now: float, horizon_s: float, z_floor: float, z_full: float, least: int, stride_s: float) -> int:
    """Saves new scores of the players in windows scored since the last time; how many."""
    last = store.progress(f"leakscore-{version}@").withColumnRenamed("until", "scored_until")
    fresh = store.progress(f"leak-{version}@").join(last, "org_id", "left").filter(F.col("scored_until").isNull() | (F.col("until") > F.col("scored_until")))
    ends = {r["org_id"]: r["until"] for r in fresh.collect()}
    if not ends:
        return 0
    mine = store.read("leakage").filter(F.col("model_version") == version).join(fresh, "org_id")
    touched = mine.filter(F.col("scored_until").isNull() | (F.col("window_end") > F.col("scored_until"))).select("org_id", "player_id").distinct()
    rows = totals(store, version, now, horizon_s).join(touched, ["org_id", "player_id"]).withColumn("z", L.z())
    score, n = L.calibrated(F.col("z"), F.col("n"), z_floor, z_full, least), F.col("n")
    said = gain_summary(F.col("z"), score, F.col("sum_gain") / n, n, stride_s, least)
    out = rows.select("org_id", "player_id", F.lit(version).alias("model_version"), F.lit(now).alias("computed_at"), "z", score.alias("score"), n.alias("moves"), (n * stride_s / 3600).alias("hours"), said.alias("summary"))
    if not store.save(f"leakscore-{version}@{now:.0f}", {"leakage_scores": out}, ends):
        return 0
    return store.read("leakage_scores").filter((F.col("model_version") == version) & (F.col("computed_at") == now)).count()
