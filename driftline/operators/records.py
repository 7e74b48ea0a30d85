"""Records around the evidence: validation, keyed reads, ids, orders, health and names, as DataFrame to DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .state import numbered

# fixed values: what a payload may hold
PLAYER_ID = "^[A-Za-z0-9_-]{1,64}$"
CLASS_NAME = "^[A-Za-z0-9_]{1,64}$"
MOST_PLAYERS, LONGEST_NAME, FARTHEST = 500, 128, 1e8


def to_metres(samples: DataFrame, units: float = 100.0) -> DataFrame:
    """Positions in game units as trajectory samples: metres, and seconds since the epoch."""
    seconds = F.unix_micros("server_ts") / 1e6
    return samples.select("server_id", seconds.alias("t"), "player_id", (F.col("x") / units).alias("x"), (F.col("y") / units).alias("y"), "dino_class")


def flattened(snapshots: DataFrame) -> DataFrame:
    """A row per player of each snapshot: the snapshot's columns, then the player's."""
    own = [c for c in snapshots.columns if c != "players"]
    return snapshots.select(*own, F.explode("players").alias("_p")).select(*own, "_p.*")


def problem(players: Column) -> Column:
    """Why a snapshot's players can't be stored: the first rule they break, null if none."""
    bad = lambda rule: F.exists(players, lambda p: ~F.coalesce(rule(p), F.lit(False)))
    near = lambda v: v.between(-FARTHEST, FARTHEST) & ~F.isnan(v)
    return (
        F.when(F.size(players) > MOST_PLAYERS, "too many players")
        .when(bad(lambda p: p["player_id"].rlike(PLAYER_ID)), "player id")
        .when(bad(lambda p: F.length(p["player_name"]) <= LONGEST_NAME), "player name")
        .when(bad(lambda p: p["dino_class"].isNull() | p["dino_class"].rlike(CLASS_NAME)), "class")
        .when(bad(lambda p: p["growth"].isNull() | p["growth"].between(0, 1)), "growth")
        .when(bad(lambda p: near(p["x"]) & near(p["y"]) & near(p["z"])), "coordinates")
        .when(F.size(F.array_distinct(F.transform(players, lambda p: p["player_id"]))) < F.size(players), "duplicate player")
    )


def where(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the given values; those given as None aren't asked for."""
    conditions = (F.col(c) == v for c, v in wanted.items() if v is not None)
    return rows.filter(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def sightings_after(rows: DataFrame, org: str, player: str, after: Column) -> DataFrame:
    """One player's sightings strictly after a time, in order."""
    return where(rows, org_id=org, player_id=player).filter(F.col("at") > after).orderBy("at")


def first_times(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(at).alias("first"))


def with_ids(new: DataFrame, last: int, order: list[Column], name: str = "id") -> DataFrame:
    """New rows numbered on from the highest id stored, in a given order, the same on every run."""
    return numbered(new, order, "_n").withColumn(name, F.col("_n") + 1 + last).drop("_n")


def due(outbox: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Pending deliveries whose time has come, the longest due first."""
    return outbox.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "id").limit(limit)


def newest_first(rows: DataFrame, at: str = "created_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key))


def peek(queue: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n oldest rows of a queue."""
    return queue.orderBy(key).limit(n)


def acknowledged(queue: DataFrame, upto: int, key: str = "id") -> DataFrame:
    """The queue without what was taken."""
    return queue.filter(F.col(key) > upto)


def drawn(rows: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows without replacement, by a seeded hash of their keys: the same on every run."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values that aren't null, numbered in their order."""
    return numbered(rows.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct(), [F.col("value")], "code")


def outcomes(rows: DataFrame, keys: list[str], column: str, kinds: tuple) -> DataFrame:
    """How many rows of each key came to each of the outcomes."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(column) == k).alias(k) for k in kinds])


def server_status(servers: DataFrame, health: DataFrame) -> DataFrame:
    """Every configured server with its last health: players a poll, and the share of lines that weren't clean, in percent."""
    keys = ["org_id", "server_id"]
    rows = servers.join(health.withColumn("_seen", F.lit(True)), keys, "left")
    per_poll = F.when(F.col("polls") > 0, F.col("players") / F.col("polls")).otherwise(0.0)
    bad = (F.col("salvaged") + F.col("unparsed")) / F.greatest(F.lit(1), F.col("lines") + F.col("salvaged")) * 100
    seen = F.coalesce("_seen", F.lit(False))
    return rows.select(*keys, seen.alias("uploaded"), F.when(seen, per_poll).alias("players_per_poll"), F.when(seen, bad).alias("percent_bad"))


def union_of_keys(parts: DataFrame, keys: list[str], column: str, most: int = 20) -> DataFrame:
    """The sorted union of arrays of names, at most so many of them."""
    names = parts.select(*keys, F.explode(column).alias("_k")).distinct()
    first = W.partitionBy(*keys).orderBy("_k")
    kept = names.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("_k")).alias(column))


def summed(parts: DataFrame, keys: list[str], values: tuple) -> DataFrame:
    """Additive evidence together, and how far its count exceeds chance where it has `seen` and `chance`."""
    return parts.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def manifests(rows: DataFrame) -> DataFrame:
    """(org, rows): what an export holds, from its manifests alone; a window written again counts once, as last written."""
    last = W.partitionBy("org", "window_end").orderBy(F.desc("written_at"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").groupBy("org").agg(F.sum("rows").alias("rows"))
