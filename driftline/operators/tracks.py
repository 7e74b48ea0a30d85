"""More sequence operators on the grid, and what reports need of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..rules import Rules
from .grid import PLAYER, by_step, pairs, square
from .state import Table


def trailing_mean(rows: DataFrame, value: str, steps: int, keys: tuple = PLAYER) -> Column:
    """Mean of the values of this and the last `steps` steps, of those that are there."""
    return F.avg(value).over(W.partitionBy(*keys).orderBy("idx").rangeBetween(-steps, 0))


def lives(grid: DataFrame, rules: Rules) -> DataFrame:
    """Adds life_start: where the player last appeared, jumped or changed class, and since, the steps from there."""
    order = W.partitionBy(*PLAYER).orderBy("idx")
    lag = lambda c: F.lag(c).over(order)
    way = (F.col("x") - lag("x")) * (F.col("x") - lag("x")) + (F.col("y") - lag("y")) * (F.col("y") - lag("y"))
    new = F.coalesce(lag("idx") != F.col("idx") - 1, F.lit(True)) | (way > rules.respawn_m**2) | ~F.col("dino_class").eqNullSafe(lag("dino_class"))
    rows = grid.withColumn("_new", F.when(new, F.col("idx")))
    return rows.withColumn("life_start", F.max("_new").over(order)).drop("_new").withColumn("since", F.col("idx") - F.col("life_start"))


def last_heading(rows: DataFrame) -> DataFrame:
    """Adds (hx, hy): the way of the last step at which the player moved, this one included."""
    order = W.partitionBy(*PLAYER).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({f"h{c}": F.last_value(F.when(F.col("moving"), F.col(f"d{c}")), F.lit(True)).over(order) for c in "xy"})


def nearest_slots(steps: DataFrame, n: int, radius: float) -> DataFrame:
    """(server_id, player_id, idx, slot, player_id_j, distance2): the n nearest others within the radius at each step."""
    way = lambda a, b, c: b[c] - a[c]
    square_ = lambda a, b: way(a, b, "x") * way(a, b, "x") + way(a, b, "y") * way(a, b, "y")

    def nearest(me: Column) -> Column:
        near = F.filter("all", lambda p: (p["player_id"] != me["player_id"]) & (square_(me, p) <= radius * radius))
        return F.slice(F.array_sort(F.transform(near, lambda p: F.struct(square_(me, p).alias("distance2"), p["player_id"].alias("player_id_j")))), 1, n)

    each = F.transform("all", lambda me: F.struct(me["player_id"].alias("player_id"), nearest(me).alias("near")))
    rows = by_step(steps, "x", "y").select("server_id", "idx", F.inline(each)).filter(F.size("near") > 0)
    rows = rows.select("server_id", "player_id", "idx", F.posexplode("near").alias("slot", "near"))
    return rows.select("server_id", "player_id", "idx", (F.col("slot") + 1).alias("slot"), "near.player_id_j", "near.distance2")


def neighbourhood(grid: DataFrame, margin: float, reach: float) -> DataFrame:
    """How many others each player has in range and a margin (n_visible), and beyond that within reach (n_beyond)."""
    place = grid.select("server_id", "idx", "player_id", "x", "y", "aware")
    rows = pairs(place, place.drop("aware")).withColumn("_d", square())
    seen = F.col("_d") <= (F.col("aware") + margin) * (F.col("aware") + margin)
    return rows.groupBy(*PLAYER, "idx").agg(F.count_if(seen).alias("n_visible"), F.count_if(~seen & (F.col("_d") <= reach * reach)).alias("n_beyond"))


def segments(samples: DataFrame, gap_s: float) -> DataFrame:
    """(server_id, player_id, segment, first, last, points): stretches of a raw track without a longer gap."""
    order = W.partitionBy(*PLAYER).orderBy("t")
    new = F.coalesce(F.col("t") - F.lag("t").over(order) > gap_s, F.lit(True)).cast("int")
    rows = samples.withColumn("_n", new).withColumn("segment", F.sum("_n").over(order))
    return rows.groupBy(*PLAYER, "segment").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("points"))


def map_point(x: Column, y: Column, matrix: tuple) -> tuple[Column, Column]:
    """An affine map of a point: matrix is two rows of three."""
    (a, b, c), (d, e, f) = matrix
    return F.lit(a) * x + F.lit(b) * y + F.lit(c), F.lit(d) * x + F.lit(e) * y + F.lit(f)


def map_scale(matrix: tuple) -> float:
    """Units of the map to a metre: the root of the absolute determinant."""
    (a, b, _), (d, e, _) = matrix
    return abs(a * e - b * d) ** 0.5


def redacted(text: Column) -> Column:
    """Text without what must not be logged: secrets in addresses, mail addresses, passwords, control characters."""
    out = F.regexp_replace(text, r"(https?://[^\s/]+/)[^\s]+", "$1***")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+", "***@***")
    out = F.regexp_replace(out, r"(?i)(password\s*[:=]\s*)\S+", "$1***")
    return F.regexp_replace(out, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def parse_health(lines: DataFrame) -> DataFrame:
    """(response_id, lines, players, salvaged, unparsed, errors) of parsed lines, as additive counts and a map of reasons."""
    reasons = lines.filter("reason is not null").groupBy("response_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    maps = reasons.groupBy("response_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("errors"))
    kept = F.col("player_id").isNotNull()
    sums = lines.groupBy("response_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(kept).alias("players"), F.count_if(kept & F.col("salvaged")).alias("salvaged"), F.count_if(~kept).alias("unparsed"))
    return sums.join(maps, "response_id", "left")


def health_sum(parts: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """Parse health of several responses together; of the reasons the `most` commonest, ties by name."""
    sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("lines", "players", "salvaged", "unparsed")])
    each = parts.select(*keys, F.explode("errors").alias("reason", "n")).groupBy(*keys, "reason").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), "reason") if keys else W.orderBy(F.desc("n"), "reason")
    top = each.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    maps = top.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("errors"))
    return sums.join(maps, keys, "left") if keys else sums.join(maps)


#: Rounds of nearest_approach: the first looks 1 / 2^(ROUNDS - 1) of the radius far, each further one twice as far.
ROUNDS = 8


def tracking(head: DataFrame) -> DataFrame:
    """(server_id, player_id, idx, player_id_j, cos): the nearest other at each step of a moving player, and the cosine of heading for them."""

    def nearest(me: Column) -> Column:
        way = lambda p, c: p[c] - me[c]
        square_ = lambda p: way(p, "x") * way(p, "x") + way(p, "y") * way(p, "y")
        others = F.filter("all", lambda p: p["player_id"] != me["player_id"])
        return F.array_min(F.transform(others, lambda p: F.struct(square_(p).alias("d"), p["player_id"].alias("player_id_j"), way(p, "x").alias("rx"), way(p, "y").alias("ry"))))

    moving = F.filter("all", lambda p: p["moving"])
    each = F.transform(moving, lambda me: F.struct(me["player_id"].alias("player_id"), me["dx"].alias("dx"), me["dy"].alias("dy"), nearest(me).alias("n")))
    best = by_step(head, "x", "y", "dx", "dy", "moving").select("server_id", "idx", F.inline(each)).filter("n is not null")
    cos = (F.col("n.rx") * F.col("dx") + F.col("n.ry") * F.col("dy")) / F.nullif(F.sqrt(F.col("n.d") * (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), F.lit(0.0))
    return best.select(*PLAYER, "idx", F.col("n.player_id_j").alias("player_id_j"), cos.alias("cos"))


def nearest_approach(mine: DataFrame, grid: DataFrame, radius: float, most: int) -> DataFrame:
    """(server_id, player_id, player_id_j, distance2): who ever came how near to where a player ever was, at any times.

    Points meet in cells, first of a small reach, then of twice that, up to the radius. What is found within a reach is
    the least of its pair, and nearer than all that isn't found: so a player who has `most` pairs is done, and for the
    others only pairs go on that weren't found yet. Points that aren't finite take no part.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    points = lambda g: Table(g.filter(finite).select(*PLAYER, "x", "y").distinct()).df
    left = points(mine)
    right = left if grid is mine else points(grid)
    pair = [*PLAYER, "player_id_j"]
    found, open_, reach = None, None, radius / 2 ** (ROUNDS - 1)
    while True:
        best = Table(_within(left, right, reach, open_)).df
        found = best if found is None else found.unionByName(best)
        if reach >= radius:
            break
        busy = left.select(*PLAYER).distinct().join(found.groupBy(*PLAYER).count().filter(F.col("count") >= most), [*PLAYER], "left_anti")
        others = right.select("server_id", F.col("player_id").alias("player_id_j")).distinct()
        open_ = Table(busy.join(others, "server_id").filter(F.col("player_id") != F.col("player_id_j")).join(found, pair, "left_anti")).df
        if open_.isEmpty():
            break
        reach = min(radius, 2 * reach)
    order = W.partitionBy(*PLAYER).orderBy("distance2", "player_id_j")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def _within(left: DataFrame, right: DataFrame, reach: float, open_: DataFrame | None) -> DataFrame:
    """(server_id, player_id, player_id_j, distance2): the least squared distance within the reach of each pair, of those
    in `open_` if given."""
    side = reach * (1 + 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    touched = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    keys = ["server_id", "_cx", "_cy"]
    theirs = right.select("server_id", F.col("player_id").alias("player_id_j"), F.col("x").alias("x_j"), F.col("y").alias("y_j"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    if open_ is not None:
        left = open_.join(left, [*PLAYER])
        keys.append("player_id_j")
    ours = left.withColumn("_cx", touched("x")).withColumn("_cy", touched("y"))
    rows = ours.join(theirs, keys).withColumn("_d", square()).filter((F.col("_d") <= reach * reach) & (F.col("player_id") != F.col("player_id_j")))
    return rows.groupBy(*PLAYER, "player_id_j").agg(F.min("_d").alias("distance2"))


def summary(rows: DataFrame, kind: str, value: str, flag_at: float) -> DataFrame:
    """(kind, n, mean, most, p90, flagged): how a score is spread in each kind of player."""
    v = F.col(value)
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.percentile(v, 0.9).alias("p90"), F.median(v).alias("middle"), F.avg((v >= flag_at).cast("double")).alias("flagged"))
