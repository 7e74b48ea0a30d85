"""What pairs and players do on the grid: waits, runs, company, meetups, spawns, ambushes, beelines, tips."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..rules import Rules
from .grid import PLAYER, Pieces, _at, at_each_shift, close, counted, falls, headings, islands, meeting, n_shifts, of_grid, square, who_dies
from .state import Table

PAIR = ("server_id", "shift", "player_id", "player_id_j")


def steps_from(tracks: Pieces, since: DataFrame | None) -> DataFrame:
    """The grid of the pieces, from the step on from which each server counts."""
    if since is None:
        return tracks.steps()
    rows = tracks.rows.join(since, "server_id").withColumn("a", F.greatest("a", "count_from")).filter("a <= b").drop("count_from")
    return replace(tracks, rows=rows, stored=True).steps()


def moving_seconds(grid: DataFrame, rules: Rules) -> DataFrame:
    return headings(grid, rules).groupBy(*PLAYER).agg((F.count_if("moving") * F.lit(rules.step_s)).alias("moving_s"))


def moving_runs(grid: DataFrame, rules: Rules) -> DataFrame:
    return islands(headings(grid, rules).filter("moving"), PLAYER)


def waits(grid: DataFrame, rules: Rules, extra: tuple = ()) -> DataFrame:
    """Runs of at least wait_min_s in which the speed, averaged over three steps, is below still_speed; with aggregates of
    their rows.

    A step that is unknown makes the averages with it unknown, but the missing one before the window counts as zero.
    """
    order = W.partitionBy(*PLAYER).orderBy("idx")
    at = lambda c, k: F.max(c).over(order.rangeBetween(k, k))
    rows = grid.withColumn("_s", F.hypot(at("x", 1) - F.col("x"), at("y", 1) - F.col("y")) / F.lit(rules.step_s))
    back = F.when(F.col("idx") == 0, F.lit(0.0)).otherwise(at("_s", -1))
    mean = (back + F.col("_s") + at("_s", 1)) / 3
    still = rows.withColumn("_m", mean).filter(F.col("_m") < rules.still_speed)
    return islands(still, PLAYER, extra=extra).filter(F.col("run_end") - F.col("run_start") + 1 >= rules.steps(rules.wait_min_s))


def near(grid: DataFrame, rules: Rules, tracks: Pieces | None = None) -> DataFrame:
    """(server_id, idx, player_id, player_id_j, d2): who is within associate_radius_m of whom, once a pair, written once
    for all that asks who is near. With the pieces of the tracks the grid isn't read."""
    if tracks is None:
        place = grid.select("server_id", "idx", "player_id", "x", "y")
        rows = close(place, place, rules.associate_radius_m, ordered=True).withColumn("d2", square())
    else:
        rows = meeting(tracks.dealt(), tracks.dealt(), rules, radius=rules.associate_radius_m, ordered=True)
    return Table(rows.select("server_id", "idx", "player_id", "player_id_j", "d2")).df


def both_orders(rows: DataFrame) -> DataFrame:
    """Pairs, and the same pairs the other way round."""
    turned = {"player_id": "player_id_j", "player_id_j": "player_id"}
    return rows.unionByName(rows.select(*[F.col(turned.get(c, c)).alias(c) for c in rows.columns]))


def associates(grid: DataFrame, rules: Rules, beside: DataFrame | None = None) -> DataFrame:
    """(server_id, player_id, player_id_j) in both orders: pairs within associate_radius_m for associate_min_s in all.

    `beside` is what `near` has found, if that is known already.
    """
    beside = near(grid, rules) if beside is None else beside
    found = beside.groupBy("server_id", "player_id", "player_id_j").count().filter(F.col("count") * rules.step_s >= rules.associate_min_s).drop("count")
    return both_orders(found)


def _met(steps: DataFrame, rules: Rules) -> DataFrame:
    """(PAIR, run_start, run_end, then): runs of steps at which two are close, of those that last; then is j's last step."""
    runs = islands(steps, PAIR, extra=(F.max_by("then", "idx").alias("then"),))
    return runs.filter(F.col("run_end") - F.col("run_start") + 1 >= rules.steps(rules.meet_min_s))


def _meetups(runs: DataFrame, mine: DataFrame, others: DataFrame, tracks: Pieces, dead: DataFrame, since: DataFrame | None) -> DataFrame:
    """Meetups of each pair and shift, fights excluded. One that begins as context isn't counted, but separates the next.

    Runs are few: only for them it is looked up who died, and only between two whether the pair was apart.
    """
    rules = tracks.rules
    key = [*PAIR, "run_start"]
    runs = Table(runs.withColumn("until", F.lag("run_end").over(W.partitionBy(*PAIR).orderBy("run_start")))).df
    block = F.explode(F.sequence(F.expr(f"(until + 1) div {tracks.block}"), F.expr(f"(run_start - 1) div {tracks.block}"))).alias("_block")
    gaps = runs.filter("until is not null").select(*key, "until", block)
    mine = gaps.join(mine, ["server_id", "player_id", "_block"])
    rows = meeting(mine.withColumnRenamed("shift", "_shift"), others, rules, on=("player_id_j",), carry=("_shift", "run_start", "until"))
    rows = rows.filter((F.col("shift") == F.col("_shift")) & (F.col("idx") > F.col("until")) & (F.col("idx") < F.col("run_start")) & (F.col("d2") > rules.apart_m**2))
    apart = rows.select(*key).distinct().withColumn("_apart", F.lit(True))
    runs = runs.join(apart, key, "left")
    for who, step, name in (("player_id", "run_end", "_fell"), ("player_id_j", "then", "_fell_j")):
        at = ["server_id", who, step]
        runs = runs.join(who_dies(runs, dead, rules, who, step, at).withColumn(name, F.lit(True)), at, "left")
    separate, fight = F.col("until").isNull() | F.col("_apart").isNotNull(), F.col("_fell").isNotNull() | F.col("_fell_j").isNotNull()
    return counted(runs, since, "run_start").groupBy(*PAIR).agg(F.count_if(separate & ~fight).alias("meets"))


def meetups(grid: DataFrame, rules: Rules, since: DataFrame | None = None, tracks: Pieces | None = None) -> DataFrame:
    """(server_id, player_a, player_b, meets, null_meets) of the pairs that met; null_meets is the mean over the shifts.

    Only steps at which two are close are gathered by pair, and the shifted ones for pairs that met. Without the pieces of
    the tracks each step of the grid is one.
    """
    given = tracks is not None
    tracks = tracks if given else of_grid(grid, rules)
    pair = ["server_id", "player_id", "player_id_j"]
    dead = Table(falls(tracks.steps() if given else grid, rules).select(*PLAYER, "idx")).df
    here = tracks.dealt()
    runs = _met(meeting(here, here, rules, radius=rules.meet_radius_m, ordered=True), rules)
    seen = Table(_meetups(runs, here, here, tracks, dead, since).filter("meets > 0").drop("shift")).df
    mine = tracks.dealt(seen.select(*pair).join(tracks.rows, [*PLAYER]))
    who = seen.select("server_id", F.col("player_id_j").alias("player_id")).distinct()
    other = tracks.dealt(tracks.shifted().join(who, [*PLAYER], "left_semi"))
    runs = _met(meeting(mine, other, rules, on=("player_id_j",), radius=rules.meet_radius_m), rules)
    by_chance = _meetups(runs, mine.drop("player_id_j").distinct(), other, tracks, dead, since)
    null = by_chance.groupBy(*pair).agg(F.sum("meets").alias("by_chance"))
    used = tracks.rows.select("server_id", "n").distinct().select("server_id", n_shifts(F.col("n"), rules).alias("used"))
    rows = seen.join(null, pair, "left").join(used, "server_id")
    mean = F.coalesce(F.col("by_chance"), F.lit(0)) / F.greatest(F.lit(1.0), F.col("used").cast("double"))
    return rows.select("server_id", F.col("player_id").alias("player_a"), F.col("player_id_j").alias("player_b"), F.col("meets").cast("long").alias("meets"), mean.alias("null_meets"))


def spawn_episodes(grid: DataFrame | None, assoc: DataFrame, rules: Rules, since: DataFrame | None = None, beside: DataFrame | None = None, tracks: Pieces | None = None) -> DataFrame:
    """(server_id, player_id, idx, dino_class, duration_s, censored): from each spawn to the first contact.

    A spawn is an appearance, a jump or a change of class after the grid's begin; the life lasts to the next spawn or
    until the player is gone. `beside` is what `near` has found, which contacts are among unless they are made from afar.
    """
    grid = grid if tracks is None else tracks.steps()
    order = W.partitionBy(*PLAYER).orderBy("idx")
    lag = lambda c: F.lag(c).over(order)
    new_run = F.coalesce(lag("idx") != F.col("idx") - 1, F.lit(True))
    way = (F.col("x") - lag("x")) * (F.col("x") - lag("x")) + (F.col("y") - lag("y")) * (F.col("y") - lag("y"))
    changed = ~F.col("dino_class").eqNullSafe(lag("dino_class"))
    spawned = (F.col("idx") > 0) & (new_run | (way > rules.respawn_m**2) | changed)
    lives = grid.select("server_id", "idx", "player_id", "x", "y", "dino_class", spawned.alias("spawned"), new_run.alias("new_run"))
    lives = lives.withColumn("life", F.sum((F.col("spawned") | F.col("new_run")).cast("int")).over(order))
    if beside is None or rules.contact_m > rules.associate_radius_m:
        place = grid.select("server_id", "idx", "player_id", "x", "y")
        beside = close(place, place, rules.contact_m, ordered=True).select("server_id", "idx", "player_id", "player_id_j", square().alias("d2"))
    touch = both_orders(beside.filter(F.col("d2") <= rules.contact_m**2).drop("d2")).join(assoc, ["server_id", "player_id", "player_id_j"], "left_anti").select(*PLAYER, "idx")
    life = lives.groupBy(*PLAYER, "life").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("steps"), F.min_by("spawned", "idx").alias("spawned"), F.min_by("dino_class", "idx").alias("dino_class"))
    # contacts belong to the life that has begun last: lives and contacts are few beside the steps, which stay where they are
    both = life.drop("life").withColumn("begins", F.lit(1)).unionByName(touch.withColumn("begins", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("life", F.sum("begins").over(order.orderBy("idx", F.desc("begins")).rowsBetween(W.unboundedPreceding, 0)))
    once = lambda c: F.max(c).alias(c)
    life = both.groupBy(*PLAYER, "life").agg(F.min("idx").alias("idx"), once("steps"), F.min(F.when(F.col("begins") == 0, F.col("idx"))).alias("hit"), once("spawned"), once("dino_class"))
    life = life.filter(F.col("spawned") & (F.col("hit").isNotNull() | (F.col("steps") >= rules.steps(rules.spawn_min_s))))
    lasted = F.coalesce(F.col("hit") - F.col("idx"), F.col("steps")) * F.lit(rules.step_s)
    return counted(life, since).select(*PLAYER, "idx", "dino_class", lasted.alias("duration_s"), F.col("hit").isNull().alias("censored"))


def ambushes(grid: DataFrame | None, assoc: DataFrame, rules: Rules, since: DataFrame | None = None, tracks: Pieces | None = None) -> DataFrame:
    """(server_id, player_id, waits, hits, null_hits): waits that end with the arrival and death of someone once out of range.
    With the pieces of the tracks the grid isn't read; else each of its steps is one."""
    if tracks is None:
        tracks = of_grid(grid, rules)
    else:
        grid = tracks.steps()
    spot = (F.avg("x").alias("x"), F.avg("y").alias("y"), F.min_by("aware", "idx").alias("aware"), F.max("n").alias("n"))
    spell = Table(counted(waits(grid, rules, spot), since, "run_start")).df
    steps = spell.withColumns({"_lo": F.col("run_start"), "_hi": F.least(F.col("run_end") + rules.steps(rules.wait_grace_s), F.col("n") - 1)})
    seen = tracks.of(at_each_shift(steps, rules), "", "_j", F.col("_off")).filter(F.col("player_id") != F.col("player_id_j"))
    seen = seen.withColumn("idx", F.explode(F.sequence("_lo", "_hi"))).select(*PAIR, "run_start", "idx", (F.col("idx") - F.col("off_j")).alias("then"), "x", "y", "aware", *[_at(c, F.col("idx"), rules, "_j").alias(f"{c}_j") for c in "xy"])
    seen = seen.withColumn("_d", square())
    here = F.col("_d") <= rules.wait_radius_m**2
    away = (F.col("idx") == F.col("run_start")) & (F.col("_d") > F.col("aware") * F.col("aware"))
    each = seen.filter(here | away).groupBy(*PAIR, "run_start").agg(F.max(away).alias("far"), F.min_by("then", F.when(here, F.col("idx"))).alias("then"))
    # only of those who came it is looked up who died
    each = Table(each.filter("far and then is not null")).df
    key = ["server_id", "player_id_j", "then"]
    each = each.join(who_dies(each, falls(grid, rules), rules, "player_id_j", "then", key), key, "left_semi")
    each = each.join(assoc, ["server_id", "player_id", "player_id_j"], "left_anti")
    hits = each.select("server_id", "player_id", "shift", "run_start").distinct()
    hits = hits.groupBy(*PLAYER).agg(F.count_if(F.col("shift") == 0).alias("hits"), F.count_if(F.col("shift") > 0).alias("by_chance"))
    count = spell.groupBy(*PLAYER).agg(F.count(F.lit(1)).alias("waits"))
    used = tracks.rows.groupBy(*PLAYER).agg(F.max("n").alias("n")).withColumn("used", n_shifts(F.col("n"), rules))
    rows = used.join(count, [*PLAYER], "left").join(hits, [*PLAYER], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(*PLAYER, zero("waits").cast("long").alias("waits"), zero("hits").cast("long").alias("hits"), (zero("by_chance") / F.greatest(F.lit(1.0), F.col("used").cast("double"))).alias("null_hits"))
