"""One window of an organisation: all evidence in stages, and the scores of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import Rules
from . import approach as A
from . import evidence as E
from .grid import PLAYER, Pieces, counted
from .state import Table

PAIR_COUNTS = ("meets", "null_meets", "tips", "null_tips")


@dataclass(frozen=True)
class Evidence:
    """What a window adds: by pair over all servers, by player and server, spawns, who was there, and the clans in force."""

    pairs: DataFrame
    beeline: DataFrame
    ambush: DataFrame
    spawns: DataFrame
    players: DataFrame
    clans: DataFrame


def pair_evidence(grid: DataFrame | None, assoc: DataFrame, rules: Rules, since: DataFrame | None = None, tracks: Pieces | None = None) -> DataFrame:
    """(player_a, player_b, meets, null_meets, tips, null_tips), summed over servers."""
    met = E.meetups(grid, rules, since, tracks).select("player_a", "player_b", "meets", "null_meets", F.lit(0).cast("long").alias("tips"), F.lit(0.0).alias("null_tips"))
    told = A.tips(grid, assoc, rules, since, tracks).select("player_a", "player_b", F.lit(0).cast("long").alias("meets"), F.lit(0.0).alias("null_meets"), F.col("tips").cast("long").alias("tips"), "null_tips")
    return added(met, told)


def added(*parts: DataFrame) -> DataFrame:
    """The sum of pair evidence of several windows or kinds."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("player_a", "player_b").agg(*[F.sum(c).alias(c) for c in PAIR_COUNTS])


def clanmates(grid: DataFrame, clans: DataFrame) -> DataFrame:
    """(server_id, player_id, player_id_j), both orders: players of one clan that are on the same server."""
    here = grid.select(*PLAYER).distinct().join(clans, "player_id")
    other = here.select("server_id", "clan", F.col("player_id").alias("player_id_j"))
    return here.join(other, ["server_id", "clan"]).filter(F.col("player_id") != F.col("player_id_j")).drop("clan")


def extract(grid: DataFrame | None, rules: Rules, since: DataFrame | None = None, prior_pairs: DataFrame | None = None, tracks: Pieces | None = None) -> Evidence:
    """All evidence of one window, in stages: pairs first, clans from them and the horizon's, then what players do.

    Companions are no targets of either stage; clanmates aren't of the second, where what a clan knows is shared. The
    window's pairs are its own, without the prior ones. Each stage is written once, as the next reads it many times. With
    the pieces of the tracks everything is found from them, and the grid isn't read.
    """
    there = grid if tracks is None else tracks.rows
    beside = E.near(grid, rules, tracks)
    assoc = Table(E.associates(grid, rules, beside)).df
    pairs = Table(pair_evidence(grid, assoc, rules, since, tracks)).df
    horizon = pairs if prior_pairs is None else added(pairs, prior_pairs.select(*pairs.columns))
    clans = A.clans(A.clan_links(horizon, rules))
    never = Table(assoc.unionByName(clanmates(there, clans)).distinct()).df
    found = Table(A.episodes(grid, never, rules, clans=clans, since=since, tracks=tracks)).df
    return Evidence(
        pairs=pairs,
        beeline=A.beelines(grid, found, rules, since, tracks),
        ambush=E.ambushes(grid, never, rules, since, tracks),
        spawns=E.spawn_episodes(grid, never, rules, since, beside, tracks),
        players=counted(there, since, "idx" if tracks is None else "b").select(*PLAYER).distinct(),
        clans=clans,
    )


def score_window(grid: DataFrame | None, rules: Rules, since: DataFrame | None = None, prior_pairs: DataFrame | None = None, tracks: Pieces | None = None) -> DataFrame:
    """Scores of every player seen in one window, with the servers they were on, highest first."""
    ev = extract(grid, rules, since, prior_pairs, tracks)
    rows = A.scores(ev.beeline, A.contact_scores(ev.spawns, rules), ev.ambush, rules)
    servers = ev.players.groupBy("player_id").agg(F.array_sort(F.collect_set("server_id")).alias("servers"))
    return ranked(servers.join(rows, "player_id"))


def ranked(scores: DataFrame) -> DataFrame:
    """Highest score first, of equal ones the smaller player id."""
    return scores.orderBy(F.desc("score"), "player_id")


def pending_windows(progress: DataFrame, rules: Rules, now: float, lag_s: float = 300.0, window_s: float = 7200.0, most: int = 12) -> DataFrame:
    """(org_id, start, end): the windows due, from each org's progress (org_id, start), the end of what is processed or its
    first position. A window is due lag_s after its end; an org gets `most` windows a run."""
    due = F.least(F.lit(most), F.floor((F.lit(now - lag_s) - F.col("start")) / F.lit(window_s)).cast("int"))
    rows = progress.filter(F.col("start").isNotNull() & (due > 0))
    k = F.explode(F.sequence(F.lit(0), due - 1)).alias("k")
    return rows.select("org_id", F.col("start").alias("_s"), k).select("org_id", (F.col("_s") + F.col("k") * window_s).alias("start"), (F.col("_s") + (F.col("k") + 1) * window_s).alias("end"))


def run_summary(windows: DataFrame, scores: DataFrame, flags: DataFrame) -> DataFrame:
    """(org_id, windows, scored, new_flags): what a run did for every org that had a window."""
    done = windows.groupBy("org_id").agg(F.count(F.lit(1)).alias("windows"))
    for rows, name in ((scores, "scored"), (flags, "new_flags")):
        done = done.join(rows.groupBy("org_id").agg(F.count(F.lit(1)).alias(name)), "org_id", "left")
    return done.na.fill(0, ["scored", "new_flags"])
