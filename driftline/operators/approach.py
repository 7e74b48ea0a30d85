"""Beelines: heading straight for someone out of range, and arriving; tips, clans and scores built on them.

Episodes are narrowed step by step: aligned steps become runs in the task where the pieces of two tracks meet, runs that
can't count go, and only for those left are the pieces around them looked up again, by player and block of steps. So it is
pieces and runs that are shuffled, and not the steps of pairs or of the grid.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import count_z, noisy_or, ramp
from ..rules import Rules
from ..sources.events import AWARENESS, AWARENESS_DEFAULT, awareness
from . import heading as H
from .evidence import PAIR, steps_from
from .grid import PLAYER, Pieces, _at, at_each_shift, before_shift, counted, falls, headings, is_moving, islands, joined, n_shifts, of_grid, square, way_ahead, who_dies
from .state import Table

RUN = (*PAIR, "run_start")


def around(runs: DataFrame, first, last, tracks: Pieces) -> DataFrame:
    """Where i and the shifted j of each run are at the steps at which both are present, from one step of the grid to another,
    with the step (then) of j before the shift."""
    rows = tracks.of(runs.withColumns({"_lo": first, "_hi": last}), "player_id")
    rows = rows.withColumn("_off", F.explode(F.array("shift", F.col("shift") - F.col("n"))))
    rows = tracks.of(rows, "player_id_j", "_j", F.col("_off")).withColumn("idx", F.explode(F.sequence("_lo", "_hi")))
    places = [_at(c, F.col("idx"), tracks.rules, end).alias(f"{c}{end}") for end in ("", "_j") for c in "xy"]
    return rows.select(*runs.columns, "idx", (F.col("idx") - F.col("off_j")).alias("then"), awareness(F.col("dino_class")).alias("aware"), *places)


def straight(dx, dy, d, rx, ry, rules: Rules):
    """Whether a way (dx, dy) heads for who is (rx, ry) away."""
    return (d > 0) & (rx * dx + ry * dy >= rules.aligned_cos * F.sqrt(d * (dx * dx + dy * dy)))


def runs_of(tracks: Pieces, rules: Rules, null: bool = True) -> DataFrame:
    """(PAIR, run_start, run_end, d0, aware0, n, arrival, whole): runs in which i moves and heads for j, that begin out of range
    and last. They are made in blocks of steps: what is `whole` within its block has arrived, of the others that is open.
    Only those, as parts, are shuffled by pair.
    """
    tracks = replace(tracks, block=H.BLOCK)
    aware = awareness(F.col("dino_class")).alias("aware")
    keys, own = ("server_id", "_block"), ("player_id", "n", "t0", "t", "x", "y", "vx", "vy", "a", "b", "off")
    movers = tracks.dealt(tracks.headed(), boxes=False).select(*keys, *own, *[f"{c}_h" for c in ("t", "x", "y", "vx", "vy")])
    everyone = tracks.dealt(tracks.everywhen(null), boxes=False).select(*keys, *own, "shift", aware)
    runs = Table(movers.groupBy(*keys).cogroup(everyone.groupBy(*keys)).applyInArrow(H.block_runs(rules, tracks.block), H.SCHEMA)).df
    firsts = tuple(F.min_by(c, "run_start").alias(c) for c in ("d0", "aware0"))
    parts = joined(runs.filter("not whole"), PAIR, rules.steps(rules.bridge_s), (*firsts, F.max("n").alias("n")))
    far = (F.col("d0") > F.col("aware0") * F.col("aware0")) & (F.col("d0") <= rules.max_start_m**2)
    parts = parts.filter(far & (F.col("run_end") - F.col("run_start") + 1 >= rules.steps(rules.aligned_min_s)))
    return runs.filter("whole").unionByName(parts.withColumns({"arrival": F.lit(None).cast("long"), "whole": F.lit(False)}))


def episodes(grid: DataFrame | None, assoc: DataFrame, rules: Rules, null: bool = True, known: bool = True, clans: DataFrame | None = None, since: DataFrame | None = None, tracks: Pieces | None = None) -> DataFrame:
    """(server_id, shift, player_id, player_id_j, run_start, arrival, distance): unmerged episodes of i towards j.

    Without `known`, what others knew and whether the two meet in peace don't matter (the display form). With the pieces of
    the tracks the grid isn't read; else each of its steps is one.
    """
    tracks = of_grid(grid, rules).kept() if tracks is None else tracks
    runs = counted(runs_of(tracks, rules, null), since, "run_start")
    # pairs in company have no runs at all, so they go when the rows are runs
    kept = ("run_end", "d0", "n")
    runs = Table(runs.join(assoc, ["server_id", "player_id", "player_id_j"], "left_anti").select(*RUN, *kept, "arrival", "whole")).df
    tail = rules.steps(rules.arrive_grace_s)
    open_ = runs.filter("not whole").select(*RUN, *kept)
    span = around(open_, F.col("run_start"), F.least(F.col("run_end") + tail, F.col("n") - 1), tracks).withColumn("_d", square())
    reach = span.groupBy(*RUN, *kept).agg(
        F.count_if((F.col("idx") <= F.col("run_end")) & (F.col("_d") > F.col("aware") * F.col("aware"))).alias("_far"),
        F.min(F.when(F.col("_d") <= rules.arrive_m**2, F.col("idx"))).alias("arrival"),
    )
    reach = reach.filter(F.col("arrival").isNotNull() & (F.col("_far") >= rules.steps(rules.aligned_min_s))).drop("_far")
    # each narrowing reads its runs twice, so they are written in between and not worked out anew
    found = Table(runs.filter("whole").drop("whole").unionByName(reach)).df
    back = F.greatest(F.lit(0).cast("long"), F.col("run_start") - rules.steps(rules.near_s))
    near = around(found, back, F.col("run_start"), tracks).filter(square() <= F.col("aware") * F.col("aware")).select(*RUN).distinct()
    found = Table(found.join(near, [*RUN], "left_anti")).df
    if known:
        found = found.join(shared(found, tracks, assoc, rules, clans), [*RUN], "left_anti")
    found = found.join(on_the_way(found, tracks, rules), [*RUN], "left_anti")
    found = Table(found).df
    found = found.join(approached(found, tracks, rules), [*RUN], "left_anti")
    if known:
        found = Table(found).df
        found = found.join(reunions(found, tracks, rules), [*RUN], "left_anti")
    return found.select(*RUN, "arrival", F.sqrt("d0").alias("distance"))


def on_the_way(found: DataFrame, tracks: Pieces, rules: Rules) -> DataFrame:
    """Runs whose player was, turn_s before, moving and heading for where they are at the arrival."""
    at = F.col("run_start") - rules.steps(rules.turn_s)
    rows = tracks.of(found.withColumns({"_lo": at, "_hi": at}), "player_id", pieces=tracks.headed())
    places = [_at(c, F.col("_lo"), rules).alias(c) for c in "xy"]
    rows = rows.select(*RUN, "arrival", "n", *places, *[way_ahead(c, F.col("_lo"), rules).alias(f"d{c}") for c in "xy"])
    rows = tracks.at(rows.filter(is_moving(F.col("dx"), F.col("dy"), rules)), "player_id", "arrival", x="px", y="py")
    tx, ty = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    norm = (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * (tx * tx + ty * ty)
    return rows.filter((norm > 0) & (F.col("dx") * tx + F.col("dy") * ty >= rules.aligned_cos * F.sqrt(norm))).select(*RUN)


def approached(found: DataFrame, tracks: Pieces, rules: Rules) -> DataFrame:
    """Runs whose target came to the player for more than max_approach of the distance."""
    rows = tracks.at(found, "player_id", "run_start", x="x", y="y")
    rows = before_shift(before_shift(rows, "run_start", "_a"), "arrival", "_b")
    rows = tracks.at(tracks.at(rows, "player_id_j", "_a", x="ax", y="ay"), "player_id_j", "_b", x="bx", y="by")
    came = (F.col("bx") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("y") - F.col("ay"))
    return rows.filter(came > rules.max_approach * F.col("d0")).select(*RUN)


def reunions(found: DataFrame, tracks: Pieces, rules: Rules) -> DataFrame:
    """Runs after whose arrival the two stay together in peace. Under a shift both deaths are the shifted ones."""
    after = around(found, F.col("arrival"), F.least(F.col("arrival") + rules.steps(rules.reunion_s), F.col("n") - 1), tracks)
    after = Table(after.filter(square() <= rules.meet_radius_m**2).select(*RUN, "idx", "then")).df
    fallen = falls(tracks.steps(), rules)
    for who in ("player_id", "player_id_j"):
        key = ["server_id", who, "then"]
        after = after.join(who_dies(after, fallen, rules, who, "then", key), key, "left_anti")
    peace = islands(after.withColumnRenamed("run_start", "_s"), (*PAIR, "_s"))
    return peace.filter(F.col("run_end") - F.col("run_start") + 1 >= rules.steps(rules.meet_min_s)).select(*PAIR, F.col("_s").alias("run_start")).distinct()


def shared(found: DataFrame, tracks: Pieces, assoc: DataFrame, rules: Rules, clans: DataFrame | None = None) -> DataFrame:
    """Runs whose target someone else knew of within shared_s before: an independent spotter, or a clanmate of i.

    A spotter has the target in range, further than meet_radius_m, and isn't its company. A clanmate counts who has it
    in range or heads for it. The times are those before the shift, as what was known moves with its target.
    """
    at = F.pmod(F.col("run_start") - F.col("shift"), F.col("n"))
    times = found.withColumns({"_lo": F.greatest(F.lit(0).cast("long"), at - rules.steps(rules.shared_s)), "_hi": at})
    times = tracks.of(times.select(*RUN, "n", "_lo", "_hi"), "player_id_j", "_j")

    def beside(pieces: DataFrame | None) -> DataFrame:
        rows = tracks.of(times, "", "_m", pieces=pieces).filter((F.col("player_id_m") != F.col("player_id")) & (F.col("player_id_m") != F.col("player_id_j")))
        rows = rows.withColumn("idx", F.explode(F.sequence("_lo", "_hi")))
        return rows.withColumns({f"r{c}": _at(c, F.col("idx"), rules, "_j") - _at(c, F.col("idx"), rules, "_m") for c in "xy"}).withColumn("_d", F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))

    aware = awareness(F.col("dino_class_m"))
    beyond = F.max(F.col("_d") > rules.meet_radius_m**2).alias("_beyond")
    seen = beside(None).filter(F.col("_d") <= aware * aware).groupBy(*RUN, "player_id_m").agg(beyond)
    company = assoc.select("server_id", F.col("player_id").alias("player_id_m"), "player_id_j")
    spotted = seen.filter("_beyond").join(company, ["server_id", "player_id_m", "player_id_j"], "left_anti").select(*RUN)
    if clans is None:
        return spotted.distinct()
    ahead = [way_ahead(c, F.col("idx"), rules, "_m") for c in "xy"]
    heads = beside(tracks.headed()).filter(is_moving(*ahead, rules) & straight(*ahead, F.col("_d"), F.col("rx"), F.col("ry"), rules))
    knew = seen.select(*RUN, "player_id_m").unionByName(heads.select(*RUN, "player_id_m")).distinct()
    theirs = clans.select(F.col("player_id").alias("player_id_m"), "clan")
    mates = knew.join(theirs, "player_id_m").join(clans.select("player_id", "clan"), ["player_id", "clan"])
    return spotted.unionByName(mates.select(*RUN)).distinct()


def merged(found: DataFrame) -> DataFrame:
    """Episodes of a player that overlap become one, with the first one's target and distance."""
    keys = ("server_id", "shift", "player_id")
    order = W.partitionBy(*keys).orderBy("run_start", "arrival", "player_id_j")
    before = F.max("arrival").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = found.withColumn("_new", (before.isNull() | (F.col("run_start") > before)).cast("int")).withColumn("_g", F.sum("_new").over(order))
    first = F.struct("run_start", "arrival", "player_id_j")
    return rows.groupBy(*keys, "_g").agg(F.min("run_start").alias("run_start"), F.max("arrival").alias("arrival"), F.min_by("player_id_j", first).alias("player_id_j"), F.min_by("distance", first).alias("distance")).drop("_g")


def beelines(grid: DataFrame | None, found: DataFrame, rules: Rules, since: DataFrame | None = None, tracks: Pieces | None = None) -> DataFrame:
    """(server_id, player_id, moving_s, episodes, null_episodes, start_sum_m) of every player in the steps that count."""
    count = merged(found).groupBy(*PLAYER).agg(F.count_if(F.col("shift") == 0).alias("episodes"), F.count_if(F.col("shift") > 0).alias("by_chance"), F.sum(F.when(F.col("shift") == 0, F.col("distance"))).alias("start_sum_m"))
    head = counted(headings(grid, rules), since) if tracks is None else headings(steps_from(tracks, since), rules)
    moving = head.groupBy(*PLAYER).agg((F.count_if("moving") * F.lit(rules.step_s)).alias("moving_s"), F.max("n").alias("n"))
    rows = moving.withColumn("used", n_shifts(F.col("n"), rules)).join(count, [*PLAYER], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    null = zero("by_chance") / F.greatest(F.lit(1.0), F.col("used").cast("double"))
    return rows.select(*PLAYER, "moving_s", zero("episodes").cast("long").alias("episodes"), null.alias("null_episodes"), F.coalesce("start_sum_m", F.lit(0.0)).alias("start_sum_m"))


def tips(grid: DataFrame | None, assoc: DataFrame, rules: Rules, since: DataFrame | None = None, tracks: Pieces | None = None) -> DataFrame:
    """(player_a, player_b, tips, null_tips): approaches of one to a target that the other had spotted just before.

    An approach clears what its player had counted so far for the target and its company, so a tip counts only after
    the last approach that excludes the tipper. With the pieces of the tracks the grid isn't read.
    """
    tracks = of_grid(grid, rules).kept() if tracks is None else tracks
    own = merged(episodes(None, assoc, rules, null=False, known=False, since=since, tracks=tracks)).drop("shift")
    own = Table(own).df.withColumn("ord", F.row_number().over(W.partitionBy(*PLAYER).orderBy("run_start", "arrival", "player_id_j")))
    with_target = assoc.select("server_id", F.col("player_id").alias("player_id_j"), F.col("player_id_j").alias("m"))
    out = own.select(*PLAYER, "player_id_j", "ord")
    excluded = out.select(*PLAYER, "ord", F.col("player_id_j").alias("m")).unionByName(out.join(with_target, ["server_id", "player_id_j"]).select(*PLAYER, "ord", "m"))
    last = excluded.groupBy(*PLAYER, "m").agg(F.max("ord").alias("last"))
    back = F.greatest(F.lit(0).cast("long"), F.col("run_start") - rules.steps(rules.shared_s))
    times = own.select(*PLAYER, "player_id_j", "ord", back.alias("_lo"), F.col("run_start").alias("_hi"))
    times = tracks.of(times.join(tracks.rows.select("server_id", "n").distinct(), "server_id"), "player_id_j", "_j")
    seen = tracks.of(at_each_shift(times, rules), "", "_m", F.col("_off"))
    seen = seen.filter((F.col("player_id_m") != F.col("player_id")) & (F.col("player_id_m") != F.col("player_id_j"))).withColumn("idx", F.explode(F.sequence("_lo", "_hi")))
    rx, ry = (_at(c, F.col("idx"), rules, "_j") - _at(c, F.col("idx"), rules, "_m") for c in "xy")
    most = max(rules.awareness_m, AWARENESS_DEFAULT, *AWARENESS.values())
    seen = seen.select(*PLAYER, "ord", F.col("player_id_m").alias("m"), "shift", "n", "idx", (rx * rx + ry * ry).alias("_d"))
    seen = seen.filter((F.col("_d") > rules.meet_radius_m**2) & (F.col("_d") <= most * most)).withColumn("_block", F.expr(f"idx div {tracks.block}"))
    # a shifted spotter keeps the awareness of the real time, and none while absent then
    real = tracks.blocks().select(F.col("server_id").alias("_s"), F.col("player_id").alias("_p"), F.col("_block").alias("_k"), "a", "b", awareness(F.col("dino_class")).alias("aware"))
    same = (F.col("server_id") == F.col("_s")) & (F.col("m") == F.col("_p")) & (F.col("_block") == F.col("_k")) & (F.col("idx") >= F.col("a")) & (F.col("idx") <= F.col("b"))
    reach = F.coalesce(F.col("aware"), F.lit(rules.awareness_m))
    seen = seen.join(real, same, "left").filter(F.col("_d") <= reach * reach)
    hits = seen.select(*PLAYER, "ord", "m", "shift", "n").distinct().join(last, [*PLAYER, "m"], "left").filter(F.col("ord") > F.coalesce("last", F.lit(0)))
    share = F.when(F.col("shift") > 0, 1.0 / F.greatest(F.lit(1.0), n_shifts(F.col("n"), rules).cast("double"))).otherwise(0.0)
    pair = (F.least("player_id", "m").alias("player_a"), F.greatest("player_id", "m").alias("player_b"))
    return hits.groupBy("server_id", *pair).agg(F.count_if(F.col("shift") == 0).alias("tips"), F.sum(share).alias("null_tips"))


def clan_links(pair_evidence: DataFrame, rules: Rules) -> DataFrame:
    """Pairs whose meetings and tips are many, and more than chance gives."""
    seen, null = F.col("meets") + F.col("tips"), F.col("null_meets") + F.col("null_tips")
    return pair_evidence.filter((seen >= rules.link_min) & (count_z(seen, null) >= rules.link_z)).select("player_a", "player_b")


def clans(links: DataFrame) -> DataFrame:
    """(player_id, clan): connected players, named by the least id. Rounds go on until no label changes; as they halve the
    way left, they are few."""
    both = links.unionByName(links.select(F.col("player_b").alias("player_a"), F.col("player_a").alias("player_b"))).distinct()
    edges = Table(both)
    labels = Table(edges.df.groupBy(F.col("player_a").alias("player_id")).agg(F.least(F.min("player_b"), F.min("player_a")).alias("clan")))
    while True:
        best = edges.df.join(labels.df.withColumnRenamed("player_id", "player_b"), "player_b").groupBy(F.col("player_a").alias("player_id")).agg(F.min("clan").alias("near"))
        step = labels.df.join(best, "player_id").select("player_id", F.least("clan", "near").alias("clan"), F.col("clan").alias("old"))
        jump = labels.df.select(F.col("player_id").alias("clan"), F.col("clan").alias("next"))
        step = step.join(jump, "clan", "left").select("player_id", F.least("clan", F.coalesce("next", "clan")).alias("clan"), "old")
        after = Table(step)
        changed = after.df.filter("clan <> old").limit(1).count()
        labels.drop()
        labels = after
        if not changed:
            break
    return labels.df.select("player_id", "clan")


def spawn_counts(spawns: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, player_id, dino_class, duration_s, censored, n): equal episodes counted. Counts of windows or servers add up, by
    being counted again together, so that nobody's episodes are ever gathered in one row."""
    n = F.col("n") if "n" in spawns.columns else F.lit(1)
    return spawns.groupBy(*by, "player_id", "dino_class", "duration_s", "censored").agg(F.sum(n.cast("long")).alias("n"))


def contact_scores(spawns: DataFrame, rules: Rules, by: tuple = ()) -> DataFrame:
    """(player_id, episodes, contacts, mean_rank, z, score): how fast a player meets others after spawning. With `by`,
    columns that come first, players are ranked among those with the same values.

    Each episode is ranked among the other players' of its class, or of all classes if those are too few: contacts
    made sooner count one, episodes left sooner half. Counts over everyone less one's own come from windows. Rows may be
    single episodes, or the counts `n` of equal ones that spawn_counts makes, which is all that ranking needs.
    """
    n = F.col("n") if "n" in spawns.columns else F.lit(1)
    rows = spawns.select(*by, "player_id", F.coalesce("dino_class", F.lit("")).alias("c"), "duration_s", F.col("censored").cast("int").alias("k"), n.cast("long").alias("n"))
    base = rows = Table(rows).df
    weight = F.sum(F.when(F.col("k") == 1, 0.5).otherwise(1.0) * F.col("n"))
    for keys, name in ((["c"], "c"), (["c", "player_id"], "oc"), ([], "a"), (["player_id"], "oa")):
        keys = [*by, *keys]
        # counts per distinct duration, of which there are no more than steps in a grid, and sums over those before
        per = base.groupBy(*keys, "duration_s").agg(weight.alias("_w"), F.sum("n").alias("_k"))
        order = W.partitionBy(*keys or [F.lit(0)])
        before = F.coalesce(F.sum("_w").over(order.orderBy("duration_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        per = per.select(*keys, "duration_s", before.alias(f"_b{name}"), F.sum("_k").over(order).alias(f"_n{name}"))
        rows = rows.join(per, [*keys, "duration_s"])
    rows = rows.withColumnsRenamed({"_bc": "bc", "_boc": "oc", "_nc": "nc", "_noc": "mc", "_ba": "ba", "_boa": "oa", "_na": "na", "_noa": "ma"})
    rows = rows.filter((F.col("ma") >= rules.spawn_min_own) & (F.col("na") - F.col("ma") >= rules.spawn_min_others))
    wide = F.col("nc") - F.col("mc") < rules.spawn_min_others
    share = F.when(wide, (F.col("ba") - F.col("oa")) / (F.col("na") - F.col("ma"))).otherwise((F.col("bc") - F.col("oc")) / F.greatest(F.lit(1), F.col("nc") - F.col("mc")))
    rank = F.when(F.col("k") == 1, (share + 1.0) / 2.0).otherwise(share)
    out = rows.groupBy(*by, "player_id").agg(F.sum("n").alias("episodes"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("contacts"), (F.sum(rank * F.col("n")) / F.sum("n")).alias("mean_rank"))
    out = out.withColumn("z", (0.5 - F.col("mean_rank")) * F.sqrt(12.0 * F.col("episodes")))
    return out.withColumn("score", ramp(F.col("z"), *rules.contact_ramp))


def scores(beeline: DataFrame, contact: DataFrame, ambush: DataFrame, rules: Rules) -> DataFrame:
    """(player_id, beeline, ttc, ambush, score, flagged) of every player in the evidence, summed over servers."""
    b = beeline.groupBy("player_id").agg(F.sum("moving_s").alias("moving_s"), F.sum("episodes").alias("e"), F.sum("null_episodes").alias("ne"))
    a = ambush.groupBy("player_id").agg(F.sum("waits").alias("waits"), F.sum("hits").alias("h"), F.sum("null_hits").alias("nh"))
    rows = b.join(a, "player_id", "full").join(contact.select("player_id", F.col("score").alias("ttc")), "player_id", "left")
    first = F.when(F.col("moving_s") >= rules.moving_min_s, ramp(count_z(F.col("e"), F.col("ne")), *rules.beeline_ramp))
    third = F.when(F.col("waits") >= rules.wait_min, ramp(count_z(F.col("h"), F.col("nh")), *rules.wait_ramp))
    rows = rows.select("player_id", first.alias("beeline"), "ttc", third.alias("ambush"))
    total = noisy_or(*zip(rules.weights, (F.col("beeline"), F.col("ttc"), F.col("ambush")), strict=True))
    return rows.withColumn("score", total).withColumn("flagged", F.col("score") >= rules.flag_at)
