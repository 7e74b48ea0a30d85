"""The scoring run: windows that are due, their evidence saved, players scored over the horizon, flags and alerts."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import Rules
from ..sources import export
from . import approach as A
from . import window as V
from .grid import Pieces, headings, pieces, spans
from .relational import apply_flags, latest, pair_quality
from .state import Table, numbered, scope
from .store import Store

SEPARATOR = "\x1f"
SCHEMAS = {
    "evidence": "org_id string, player_id string, window_end double, servers string, moving_s double, beeline_episodes long, beeline_null double, beeline_start_sum_m double, ambush_waits long, ambush_hits long, ambush_null double",
    "spawns": "org_id string, player_id string, window_end double, dino_class string, duration_s double, censored boolean",
    "pairs": "org_id string, player_a string, player_b string, window_end double, meets long, null_meets double, tips long, null_tips double",
    "scores": "org_id string, player_id string, computed_at double, score double, beeline double, ttc double, ambush double",
    "flags": "org_id string, player_id string, status string, score double, max_score double, created_at double, updated_at double, resolved_at double",
    "alerts": "org_id string, player_id string, kind string, status string, attempts int, created_at double, next_attempt_at double",
}
EXPORTED = {
    "positions": "org string, server string, player string, t double, x float, y float, z float, growth float, dino_class string, date date",
    "evidence": "org string, player string, window_end double, moving_s double, beeline_episodes int, beeline_null double, ambush_waits int, ambush_hits int, ambush_null double, spawn_episodes int, clan int, date date",
    "windows": "org string, window_end double, rows long, players long, servers long",
}
log = logging.getLogger(__name__)


def qualified(org: Column, name: Column) -> Column:
    """An id that is one org's own, so that orgs can share a run."""
    return F.concat(org, F.lit(SEPARATOR), name)


def org_of(name: str) -> Column:
    return F.substring_index(name, SEPARATOR, 1)


def bare(name: str) -> Column:
    return F.substr(F.col(name), F.length(org_of(name)) + 2)


def window_tracks(positions: DataFrame, windows: DataFrame, rules: Rules, context_s: float) -> tuple[Pieces, DataFrame]:
    """The pieces of the tracks in one window of each org in `windows` (org_id, start, end) with the time before it, and the
    step of each server from which it counts. Servers and players are qualified by their org."""
    rows = positions.join(windows, "org_id").filter((F.col("t") >= F.col("start") - context_s) & (F.col("t") < F.col("end")))
    rows = Table(rows.select(qualified(F.col("org_id"), F.col("server_id")).alias("server_id"), qualified(F.col("org_id"), F.col("player_id")).alias("player_id"), "t", "x", "y", "dino_class", "start")).df
    starts = rows.select("server_id", "start").distinct()
    since = spans(rows, rules).join(starts, "server_id").select("server_id", F.ceil((F.col("start") - F.col("t0")) / F.lit(rules.step_s)).cast("long").alias("count_from"))
    return pieces(rows.drop("start"), rules).kept(), Table(since).df


def window_grid(positions: DataFrame, windows: DataFrame, rules: Rules, context_s: float) -> tuple[DataFrame, DataFrame, Pieces]:
    """As window_tracks, with the grid before the others."""
    tracks, since = window_tracks(positions, windows, rules, context_s)
    return Table(headings(tracks.steps(), rules)).df, since, tracks


def window_evidence(positions: DataFrame, windows: DataFrame, store: Store, rules: Rules, context_s: float = 1800.0, horizon_s: float = 7 * 86_400.0) -> dict[str, DataFrame]:
    """Evidence, spawns and pairs of one window of each org in `windows` (org_id, start, end), all orgs in one pass.

    Positions are (org_id, server_id, player_id, t, x, y, dino_class), in metres. The time before a window is context;
    the clans in force come from the pairs of the horizon before.
    """
    tracks, since = window_tracks(positions, windows, rules, context_s)
    prior = store.read("pairs").join(windows.select("org_id", "end"), "org_id").filter(F.col("window_end") > F.col("end") - horizon_s)
    prior = prior.select(*[qualified(F.col("org_id"), F.col(c)).alias(c) for c in ("player_a", "player_b")], *V.PAIR_COUNTS)
    ev = V.extract(None, rules, since, prior, tracks)
    ends = windows.select("org_id", F.col("end").alias("window_end"))

    def told(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumn("org_id", org_of(names[0])).withColumns({c: bare(c) for c in names}).join(ends, "org_id")

    players = ev.players.groupBy("player_id").agg(F.array_join(F.array_sort(F.collect_set(bare("server_id"))), ",").alias("servers"))
    walks = ev.beeline.groupBy("player_id").agg(F.sum("moving_s").alias("moving_s"), F.sum("episodes").alias("beeline_episodes"), F.sum("null_episodes").alias("beeline_null"), F.sum("start_sum_m").alias("beeline_start_sum_m"))
    waits = ev.ambush.groupBy("player_id").agg(F.sum("waits").alias("ambush_waits"), F.sum("hits").alias("ambush_hits"), F.sum("null_hits").alias("ambush_null"))
    evidence = players.join(walks, "player_id", "left").join(waits, "player_id", "left").na.fill(0)
    return {"evidence": told(evidence, "player_id"), "spawns": told(ev.spawns.select("player_id", "dino_class", "duration_s", "censored"), "player_id"), "pairs": told(ev.pairs, "player_a", "player_b")}


def save_windows(store: Store, windows: list, work: Callable[[list], dict[str, DataFrame]]) -> tuple[list, list]:
    """Saves one window of each of several orgs; (saved, failed). All go in one batch, and one by one if that fails: a
    window that can't be worked out holds up its own org only."""
    own = hashlib.sha256("\0".join(f"{r['org_id']}@{r['end']}" for r in windows).encode()).hexdigest()
    try:
        with scope():
            store.save(f"window-{own}", work(windows), {r["org_id"]: float(r["end"]) for r in windows})
        return windows, []
    except Exception:
        log.exception("%d windows failed", len(windows))
        if len(windows) == 1:
            return [], windows
    parts = [save_windows(store, [w], work) for w in windows]
    return [w for done, _ in parts for w in done], [w for _, failed in parts for w in failed]


def whole(failed: list) -> None:
    """Ends what is no result without the windows that failed; why they did is in the log."""
    if failed:
        names = ", ".join(sorted(f"{r['org_id']} to {r['end']}" for r in failed))
        raise RuntimeError(f"{len(failed)} windows failed: {names}")


def run_scoring(store: Store, positions: DataFrame, rules: Rules, now: float, lag_s: float = 300.0, window_s: float = 7200.0, context_s: float = 1800.0, horizon_s: float = 7 * 86_400.0, most: int = 12, suppress_s: float = 30 * 86_400.0, evidence: Callable = window_evidence, strict: bool = False) -> DataFrame:
    """(org_id, windows, scored, new_flags): saves the windows that are due, then scores and flags who was in them.

    The k-th windows of all orgs go together, in one pass and one commit, and an org's next follows the one before. A run
    that dies leaves whole windows; the next one goes on from there, and scores also what was saved and not yet scored.
    The list of windows due, at most `most` an org, is all that comes to the driver. One run at a time writes to a store.
    A `strict` run whose windows did not all come out ends with an error once what did is saved.
    """
    first = positions.groupBy("org_id").agg(F.min("t").cast("double").alias("first"))
    progress = first.join(store.progress("window-"), "org_id", "left").select("org_id", F.coalesce("until", "first").alias("start"))
    due: dict[str, list] = {}
    for r in V.pending_windows(progress, rules, now, lag_s, window_s, most).orderBy("org_id", "end").collect():
        due.setdefault(r["org_id"], []).append(r)
    spark, done, lost = store.spark, [], []
    schema = "org_id string, start double, end double"

    def work(rows: list) -> dict[str, DataFrame]:
        windows = spark.createDataFrame([(r["org_id"], r["start"], r["end"]) for r in rows], schema)
        return evidence(positions, windows, store, rules, context_s, horizon_s)

    while turn := [rows.pop(0) for rows in due.values() if rows]:
        saved, failed = save_windows(store, turn, work)
        done, lost = done + saved, lost + failed
        for r in failed:
            due[r["org_id"]].clear()
    scored, new = score_and_flag(store, rules, now, horizon_s, suppress_s)
    if strict:
        whole(lost)
    windows = spark.createDataFrame([(r["org_id"],) for r in done], "org_id string")
    return V.run_summary(windows, scored, new)


def scored(evidence: DataFrame, spawns: DataFrame, rules: Rules) -> DataFrame:
    """(player_id, beeline, ttc, ambush, score, flagged) from evidence of any number of windows, added up; players are
    qualified by their org, and ranked by their contacts within it."""
    spawns = A.spawn_counts(spawns.withColumn("player_id", qualified(F.col("org_id"), F.col("player_id"))), ("org_id",))
    walks = evidence.select("player_id", "moving_s", F.col("beeline_episodes").alias("episodes"), F.col("beeline_null").alias("null_episodes"))
    waits = evidence.select("player_id", F.col("ambush_waits").alias("waits"), F.col("ambush_hits").alias("hits"), F.col("ambush_null").alias("null_hits"))
    return A.scores(walks, A.contact_scores(spawns, rules, ("org_id",)), waits, rules)


def evaluate(store: Store, positions: DataFrame, rules: Rules, window_s: float = 7200.0, context_s: float = 1800.0, teams: DataFrame | None = None, evidence: Callable = window_evidence) -> tuple[DataFrame, DataFrame | None]:
    """Scores (org_id, player_id, part, score, flagged), part "first" and "accumulated", and how well the clans found match teams.

    Window after window is saved, all orgs together, each with the clans of all before it; the first window's evidence
    scores alone, then the sum of all. teams are true pairs (org_id, player_a, player_b); clans come from all pairs.
    A window that fails ends it: scores of the others would look like those of all.
    """
    spans_ = positions.groupBy("org_id").agg(F.min("t").cast("double").alias("start"), F.max("t").cast("double").alias("end")).collect()
    due = [[{"org_id": r["org_id"], "start": r["start"] + k * window_s, "end": r["start"] + (k + 1) * window_s} for k in range(int((r["end"] - r["start"] + 1) // window_s))] for r in spans_]
    firsts = {rows[0]["org_id"]: rows[0]["end"] for rows in due if rows}
    spark, everything = store.spark, float("inf")

    def work(rows: list) -> dict[str, DataFrame]:
        windows = spark.createDataFrame([(r["org_id"], r["start"], r["end"]) for r in rows], "org_id string, start double, end double")
        return evidence(positions, windows, store, rules, context_s, everything)

    while turn := [rows.pop(0) for rows in due if rows]:
        whole(save_windows(store, turn, work)[1])
    early = spark.createDataFrame(list(firsts.items()), "org_id string, window_end double")
    out = None
    for part in ("first", "accumulated"):
        ev, spawns = store.read("evidence"), store.read("spawns")
        if part == "first":
            ev, spawns = (df.join(early, ["org_id", "window_end"], "left_semi") for df in (ev, spawns))
        rows = scored(ev.withColumn("player_id", qualified(F.col("org_id"), F.col("player_id"))), spawns, rules)
        rows = rows.select(org_of("player_id").alias("org_id"), bare("player_id").alias("player_id"), F.lit(part).alias("part"), "score", "flagged")
        out = rows if out is None else out.unionByName(rows)
    if teams is None:
        return out, None
    both = store.read("pairs").select(*[qualified(F.col("org_id"), F.col(c)).alias(c) for c in ("player_a", "player_b")], *V.PAIR_COUNTS)
    clans = A.clans(A.clan_links(V.added(both), rules))
    other = clans.select("clan", F.col("player_id").alias("player_b"))
    found = clans.withColumnRenamed("player_id", "player_a").join(other, "clan").filter("player_a < player_b")
    true = teams.select(*[qualified(F.col("org_id"), F.col(c)).alias(c) for c in ("player_a", "player_b")])
    return out, pair_quality(true, found)


def score_and_flag(store: Store, rules: Rules, now: float, horizon_s: float = 7 * 86_400.0, suppress_s: float = 30 * 86_400.0) -> tuple[DataFrame, DataFrame]:
    """Scores of the players in windows saved since the last scoring, and the new flags; saved with flags and alerts at once."""
    with scope():
        saved = _score_and_flag(store, rules, now, horizon_s, suppress_s)
    scores, flags = store.read("scores"), store.read("flags")
    return scores.filter((F.col("computed_at") == now) & F.lit(saved)), flags.filter((F.col("created_at") == now) & (F.col("updated_at") == now) & F.lit(saved))


def _score_and_flag(store: Store, rules: Rules, now: float, horizon_s: float, suppress_s: float) -> bool:
    last = store.progress("scores-").withColumnRenamed("until", "scored_until")
    fresh = store.progress("window-").join(last, "org_id", "left").filter(F.col("scored_until").isNull() | (F.col("until") > F.col("scored_until")))
    ends = {r["org_id"]: r["until"] for r in fresh.collect()}
    if not ends:
        return False
    evidence = store.read("evidence", now - horizon_s).filter(F.col("window_end") > now - horizon_s).withColumn("player_id", qualified(F.col("org_id"), F.col("player_id")))
    active = evidence.join(fresh, "org_id").filter(F.col("scored_until").isNull() | (F.col("window_end") > F.col("scored_until"))).select("player_id").distinct()
    spawns = store.read("spawns", now - horizon_s).filter(F.col("window_end") > now - horizon_s)
    rows = Table(scored(evidence, spawns, rules).join(active, "player_id", "left_semi")).df
    flags = latest(store.read("flags"), ["org_id", "player_id", "created_at"], ["updated_at"])
    flags = flags.withColumn("player_id", qualified(F.col("org_id"), F.col("player_id")))
    acts = Table(apply_flags(rows, flags, F.lit(now), rules.flag_at, F.lit(suppress_s))).df
    open_ = flags.filter("status = 'open'").select("player_id", "created_at")
    told = lambda df: df.withColumn("org_id", org_of("player_id")).withColumn("player_id", bare("player_id"))
    stamp = lambda df, made: told(df).select("org_id", "player_id", F.lit("open").alias("status"), "score", "max_score", made.alias("created_at"), F.lit(now).alias("updated_at"), F.lit(None).cast("double").alias("resolved_at"))
    new = stamp(acts.filter("action = 'create'"), F.lit(now))
    kept = stamp(acts.filter("action = 'refresh'").join(open_, "player_id"), F.col("created_at"))
    alerts = new.select("org_id", "player_id", F.lit("flag").alias("kind"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(now).alias("created_at"), F.lit(now).alias("next_attempt_at"))
    scores = told(rows).select("org_id", "player_id", F.lit(now).alias("computed_at"), "score", "beeline", "ttc", "ambush")
    return store.save(f"scores-{now:.0f}", {"scores": scores, "flags": new.unionByName(kept), "alerts": alerts}, ends)


def resolve(store: Store, flags: DataFrame, status: str, now: float) -> bool:
    """Closes flags (org_id, player_id, created_at), as confirmed or false positive; a later version of each."""
    rows = latest(store.read("flags"), ["org_id", "player_id", "created_at"], ["updated_at"]).join(flags, ["org_id", "player_id", "created_at"], "left_semi")
    return store.save(f"resolved-{status}-{now:.0f}", {"flags": rows.withColumns({"status": F.lit(status), "updated_at": F.lit(now), "resolved_at": F.lit(now)})})


def export_pending(store: Store, target: Store, positions: DataFrame, key: bytes, rules: Rules, window_s: float = 7200.0, horizon_s: float = 7 * 86_400.0, most: int = 24) -> tuple[int, int]:
    """Exports windows that are saved and not yet exported, at most `most`; (exported, failed).

    Each is one batch of the target: pseudonymous positions, evidence with the clans of the horizon, and its manifest. One
    that fails is tried again by the next run and holds up none of the others.
    """
    windows = store.markers().filter(F.col("batch").startswith("window-")).select(F.explode("ends").alias("org_id", "end")).distinct()
    done = failed = 0
    known = {r["batch"] for r in target.markers().select("batch").collect()}
    for r in windows.orderBy("end", "org_id").toLocalIterator():
        batch = "export-" + hashlib.sha256(f"{r['org_id']}@{r['end']}".encode()).hexdigest()
        if batch in known:
            continue
        if done + failed >= most:
            break
        try:
            with scope():
                done += target.save(batch, export_window(store, positions, key, rules, r["org_id"], r["end"], window_s, horizon_s), {r["org_id"]: r["end"]})
        except Exception:
            log.exception("export of %s failed", batch)
            failed += 1
    return done, failed


def export_window(store: Store, positions: DataFrame, key: bytes, rules: Rules, org: str, end: float, window_s: float, horizon_s: float) -> dict[str, DataFrame]:
    """Positions, evidence and manifest of one window, under pseudonyms. Players in no clan have clan -1."""
    date = F.to_date(F.timestamp_seconds(F.lit(end)))
    mine = positions.filter((F.col("org_id") == org) & (F.col("t") >= end - window_s) & (F.col("t") < end))
    rows = export.pseudonymous(mine, key)
    rows = rows.withColumns({c: F.lit(None).cast("float") for c in export.NARROW if c not in rows.columns}).withColumn("date", date)
    pairs = store.read("pairs").filter((F.col("org_id") == org) & (F.col("window_end") > end - horizon_s) & (F.col("window_end") <= end))
    clans = A.clans(A.clan_links(V.added(pairs.select("player_a", "player_b", *V.PAIR_COUNTS)), rules))
    number = numbered(clans.select("clan").distinct(), [F.col("clan")], "number")
    spawns = store.read("spawns").filter((F.col("org_id") == org) & (F.col("window_end") == end)).groupBy("player_id").agg(F.count(F.lit(1)).cast("int").alias("spawn_episodes"))
    ev = store.read("evidence").filter((F.col("org_id") == org) & (F.col("window_end") == end)).join(spawns, "player_id", "left").join(clans.join(number, "clan"), "player_id", "left")
    ids = [export.pseudonym(kind, F.col(f"{kind}_id"), key).alias(kind) for kind in ("org", "player")]
    counts = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("beeline_episodes", "ambush_waits", "ambush_hits", "spawn_episodes")]
    ev = ev.select(*ids, "window_end", "moving_s", "beeline_null", "ambush_null", *counts, F.coalesce("number", F.lit(-1)).cast("int").alias("clan"), date.alias("date"))
    manifest = rows.groupBy("org").agg(F.lit(end).alias("window_end"), F.count(F.lit(1)).alias("rows"), F.countDistinct("player").alias("players"), F.countDistinct("server").alias("servers"))
    return {"positions": rows, "evidence": ev, "windows": manifest}
