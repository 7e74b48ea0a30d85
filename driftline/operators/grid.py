"""Trajectories on a regular grid, in long form: a row only where a player is present."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..rules import Rules
from ..sources.events import awareness
from .state import cut

PLAYER = ("server_id", "player_id")


def spans(samples: DataFrame, rules: Rules) -> DataFrame:
    """(server_id, t0, n): where each server's grid begins, and its number of steps; servers with one sample time go."""
    rows = samples.groupBy("server_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).filter("t1 > t0")
    return rows.select("server_id", "t0", (F.floor((F.col("t1") - F.col("t0")) / F.lit(rules.step_s)) + 1).cast("long").alias("n"))


def counted_from(samples: DataFrame, when: float, rules: Rules) -> DataFrame:
    """(server_id, count_from): the first step of each server's grid at or after a time; what begins before is context only."""
    return spans(samples, rules).select("server_id", F.ceil((F.lit(when) - F.col("t0")) / F.lit(rules.step_s)).cast("long").alias("count_from"))


def counted(rows: DataFrame, since: DataFrame | None, begin: str = "idx") -> DataFrame:
    """The rows that begin at or after their server's count_from; all of them without one."""
    return rows if since is None else rows.join(since, "server_id").filter(F.col(begin) >= F.col("count_from")).drop("count_from")


#: Steps in a block of pieces.
BLOCK = 60


@dataclass(frozen=True)
class Pieces:
    """Tracks as straight pieces: in each a player goes from one sample towards the next over the steps a to b of the grid.

    They are some twenty times fewer than steps, so it is they that are dealt, by server and `block` of steps, and become
    steps in the tasks where they meet. Rows are (server_id, player_id, n, dino_class, t0, t, x, y, vx, vy, a, b, off): `off` is
    how far a time shift has moved them.
    """

    rows: DataFrame
    rules: Rules
    block: int = BLOCK
    parts: int | None = None
    stored: bool = False

    def steps(self) -> DataFrame:
        """The grid. A player's steps stay in one task, in order."""
        return _as_steps(self.by_player(), self.rules, "n")

    def kept(self) -> Pieces:
        """The same pieces, written once for all that asks for them."""
        return replace(self, rows=cut(self.rows), stored=True)

    def dealt(self, rows: DataFrame | None = None, boxes: bool = True) -> DataFrame:
        """Pieces cut where blocks end, with their _block and the box they lie in, those of a server's block in one task."""
        rows = self.blocks(rows)
        rows = rows.repartition(*([self.parts] if self.parts else []), "server_id", "_block")
        if not boxes:
            return rows
        ends = {c: [_at(c, F.col(e), self.rules) for e in "ab"] for c in "xy"}
        return rows.withColumns({f"{c}_{name}": f(*ends[c]) for c in "xy" for name, f in (("lo", F.least), ("hi", F.greatest))})

    def blocks(self, rows: DataFrame | None = None) -> DataFrame:
        """Pieces cut where blocks end, with their _block."""
        rows = self.rows if rows is None else rows
        rows = rows.withColumn("_block", F.explode(F.sequence(F.expr(f"a div {self.block}"), F.expr(f"b div {self.block}"))))
        first = F.col("_block") * self.block
        return rows.withColumns({"a": F.greatest("a", first), "b": F.least("b", first + (self.block - 1))})

    def dealt_steps(self) -> DataFrame:
        """The grid, those of a server at a step in one task, with their _block."""
        return _as_steps(self.dealt(), self.rules, "n", "_block")

    def headed(self) -> DataFrame:
        """The pieces with the one that the player is in heading_s later, in columns with suffix _h: each is cut so that this is
        one for all its steps. Steps after which the player isn't there by then have none."""
        k = self.rules.steps(self.rules.heading_s)
        later = F.collect_list(F.struct("a", "b", "t", "x", "y", "vx", "vy")).over(W.partitionBy(*PLAYER).orderBy("a").rowsBetween(0, k))
        rows = self.by_player().withColumn("_later", later).withColumn("_h", F.explode("_later")).drop("_later")
        rows = rows.withColumns({"a": F.greatest("a", F.col("_h.a") - k), "b": F.least("b", F.col("_h.b") - k)}).filter("a <= b")
        return rows.select("*", *[F.col(f"_h.{c}").alias(f"{c}_h") for c in ("t", "x", "y", "vx", "vy")]).drop("_h")

    def by_player(self) -> DataFrame:
        """The pieces, a player's in one task."""
        return self.rows.repartition(*([self.parts] if self.parts else []), *PLAYER) if self.stored else self.rows

    def everywhen(self, null: bool = True) -> DataFrame:
        """The pieces where they are (shift 0) and, with the null, at each usable time shift."""
        rows = self.rows.withColumn("shift", F.lit(0).cast("long"))
        return rows.unionByName(self.shifted()) if null else rows

    def of(self, rows: DataFrame, who: str, suffix: str = "", off: Column | None = None, pieces: DataFrame | None = None) -> DataFrame:
        """Rows with the pieces in which a player goes in their steps _lo to _hi, in columns with a suffix: a row for each piece
        and block, with _lo and _hi cut to it. With `off` the player is moved on by so many steps; an empty `who` stands for
        everyone on the server, who are called by the suffix then."""
        pieces = self.rows if pieces is None else pieces
        off = F.lit(0).cast("long") if off is None else off
        keys = ["server_id", *([who] if who else [])]
        own = [c for c in pieces.columns if c not in ("server_id", "player_id", "n", "off")]
        found = self.blocks(pieces).select("server_id", F.col("player_id").alias(who or f"player_id{suffix}"), "_block", *[F.col(c).alias(f"{c}{suffix}") for c in own])
        rows = rows.withColumn(f"off{suffix}", off)
        rows = rows.withColumns({"_from": F.greatest("_lo", f"off{suffix}") - F.col(f"off{suffix}"), "_to": F.least(F.col("_hi") - F.col(f"off{suffix}"), F.col("n") - 1)})
        rows = rows.filter("_from <= _to").withColumn("_block", F.explode(F.sequence(F.expr(f"_from div {self.block}"), F.expr(f"_to div {self.block}"))))
        rows = rows.join(found, [*keys, "_block"])
        ends = {"_lo": F.greatest("_from", f"a{suffix}") + F.col(f"off{suffix}"), "_hi": F.least("_to", f"b{suffix}") + F.col(f"off{suffix}")}
        return rows.withColumns(ends).filter("_lo <= _hi").drop("_from", "_to", "_block", f"a{suffix}", f"b{suffix}")

    def at(self, rows: DataFrame, who: str, step: str, **names: str) -> DataFrame:
        """Rows at whose step a player is there, with where that is, in columns of these names."""
        out = self.of(rows.withColumns({"_lo": F.col(step), "_hi": F.col(step)}), who, "_at")
        keep = [c for c in out.columns if c in rows.columns]
        return out.select(*keep, *[_at(c, F.col(step), self.rules, "_at").alias(n) for c, n in names.items()])

    def shifted(self) -> DataFrame:
        """The pieces at each usable time shift but the real one, cyclic in the server's n steps."""
        rows = self.rows.withColumn("shift", F.explode(_usable([self.rules.steps(s) for s in self.rules.null_shifts_s])))
        rows = rows.withColumn("off", F.explode(F.array(F.col("shift"), F.col("shift") - F.col("n"))))
        ends = {"a": F.greatest(F.col("a") + F.col("off"), F.lit(0).cast("long")), "b": F.least(F.col("b") + F.col("off"), F.col("n") - 1)}
        return rows.withColumns(ends).filter("a <= b")


def _parts(samples: DataFrame) -> int:
    """Into how many tasks samples are dealt that become steps: by their number, as their bytes say little of the steps."""
    n = samples.count()
    return max(1, min(samples.sparkSession.sparkContext.defaultParallelism, n // 2_000), n // 25_000)


def pieces(samples: DataFrame, rules: Rules) -> Pieces:
    """The tracks of samples: linear between samples at most max_gap_s apart.

    A sample that falls on the grid counts even if its neighbours are far. The class is that of the sample before. Of
    samples of a player at the same time the one with the least (x, y, class) counts.
    """
    parts = _parts(samples)
    first = F.min(F.struct("x", "y", "dino_class")).alias("s")
    rows = samples.groupBy(*PLAYER, "t").agg(first).select(*PLAYER, "t", "s.*").join(spans(samples, rules), "server_id")
    order = W.partitionBy(*PLAYER).orderBy("t")
    rows = rows.repartition(parts, *PLAYER).select("*", *[F.lead(c).over(order).alias(f"{c}1") for c in ("t", "x", "y")])
    step = F.lit(rules.step_s)
    since, until = (F.col("t") - F.col("t0")) / step, (F.col("t1") - F.col("t0")) / step
    near = F.coalesce(F.col("t1") - F.col("t") <= rules.max_gap_s, F.lit(False))
    last = F.when(near, F.ceil(until) - 1).otherwise(F.floor(since))
    rows = rows.withColumns({f"v{c}": F.when(near, (F.col(f"{c}1") - F.col(c)) / (F.col("t1") - F.col("t"))).otherwise(F.lit(0.0)) for c in "xy"})
    rows = rows.withColumn("a", F.ceil(since).cast("long")).withColumn("b", last.cast("long")).filter("a <= b")
    return Pieces(rows.select(*PLAYER, "n", "dino_class", "t0", "t", "x", "y", "vx", "vy", "a", "b", F.lit(0).cast("long").alias("off")), rules, parts=parts)


def of_grid(grid: DataFrame, rules: Rules) -> Pieces:
    """The pieces of a grid of which no more is known than its steps: each is one."""
    rows = grid.withColumns({**{c: F.lit(0.0) for c in ("t0", "t", "vx", "vy")}, "a": F.col("idx"), "b": F.col("idx"), "off": F.lit(0).cast("long")})
    return Pieces(rows.select(*PLAYER, "n", "dino_class", "t0", "t", "x", "y", "vx", "vy", "a", "b", "off"), rules, block=1)


def _at(c: str, idx, rules: Rules, suffix: str = ""):
    """Where a piece is at a step."""
    at = lambda name: F.col(f"{name}{suffix}")
    return at(f"v{c}") * (at("t0") + (idx - at("off")) * F.lit(rules.step_s) - at("t")) + at(c)


def way_ahead(c: str, idx: Column, rules: Rules, suffix: str = "") -> Column:
    """The way of a headed piece from a step over the next heading_s."""
    k = rules.steps(rules.heading_s)
    at = lambda name: F.col(f"{name}_h{suffix}")
    then = at(f"v{c}") * (F.col(f"t0{suffix}") + (idx + k) * F.lit(rules.step_s) - at("t")) + at(c)
    return then - _at(c, idx, rules, suffix)


def is_moving(dx: Column, dy: Column, rules: Rules) -> Column:
    """Whether so long a way over heading_s is moving."""
    return dx * dx + dy * dy >= (rules.min_speed * rules.steps(rules.heading_s) * rules.step_s) ** 2


def _as_steps(rows: DataFrame, rules: Rules, *extra: str) -> DataFrame:
    rows = rows.withColumn("idx", F.explode(F.sequence("a", "b")))
    return rows.select(*PLAYER, "idx", *[_at(c, F.col("idx"), rules).alias(c) for c in "xy"], "dino_class", awareness(F.col("dino_class")).alias("aware"), *extra)


def resample(samples: DataFrame, rules: Rules) -> DataFrame:
    """(server_id, player_id, idx, x, y, dino_class, aware, n): the steps of the pieces."""
    return pieces(samples, rules).steps()


def meeting(left: DataFrame, right: DataFrame, rules: Rules, on: tuple = (), radius: float | None = None, ordered: bool = False, carry: tuple = ()) -> DataFrame:
    """(server_id, player_id, player_id_j, shift, carry, idx, then, d2): i and j of dealt pieces at each step at which both are
    there, within the radius if one is given. `then` is the step of j before the shift.

    Pieces whose boxes are too far apart never become steps. Other columns to meet by (`on`) are j's, without suffix.
    """
    own = ("player_id", "t0", "t", "x", "y", "vx", "vy", "a", "b", "off", "x_lo", "x_hi", "y_lo", "y_hi")
    keys = ["server_id", "_block", *on]
    shift = F.col("shift") if "shift" in right.columns else F.lit(0).cast("long").alias("shift")
    right = right.select("server_id", "_block", shift, *[F.col(c).alias(f"{c}_j") for c in own])
    both = (F.col("a") <= F.col("b_j")) & (F.col("a_j") <= F.col("b"))
    if "player_id_j" not in on:
        both &= F.col("player_id") < F.col("player_id_j") if ordered else F.col("player_id") != F.col("player_id_j")
    if radius is not None:
        for c in "xy":
            reach = F.lit(float(radius) * (1 + 1e-9))
            both &= (F.col(f"{c}_lo_j") <= F.col(f"{c}_hi") + reach) & (F.col(f"{c}_lo") <= F.col(f"{c}_hi_j") + reach)
    rows = left.join(right, keys)
    rows = rows.filter(both).withColumn("idx", F.explode(F.sequence(F.greatest("a", "a_j"), F.least("b", "b_j"))))
    way = lambda c: _at(c, F.col("idx"), rules, "_j") - _at(c, F.col("idx"), rules)
    rows = rows.select("server_id", "player_id", "player_id_j", "shift", *carry, "idx", (F.col("idx") - F.col("off_j")).alias("then"), (way("x") * way("x") + way("y") * way("y")).alias("d2"))
    return rows if radius is None else rows.filter(F.col("d2") <= radius * radius)


def headings(grid: DataFrame, rules: Rules) -> DataFrame:
    """Adds (dx, dy), the way over the next heading_s, null where the player isn't there by then, and whether that is moving.

    A grid that has them already comes back as it is: they are worked out once where many operators need them.
    """
    if "moving" in grid.columns:
        return grid
    k = rules.steps(rules.heading_s)
    ahead = W.partitionBy(*PLAYER).orderBy("idx").rangeBetween(k, k)
    rows = grid.withColumn("dx", F.max("x").over(ahead) - F.col("x")).withColumn("dy", F.max("y").over(ahead) - F.col("y"))
    return rows.withColumn("moving", F.coalesce(is_moving(F.col("dx"), F.col("dy"), rules), F.lit(False)))


def deaths(grid: DataFrame, rules: Rules) -> DataFrame:
    """Adds died: whether the player disappears or jumps within fight_grace_s. The window's end is no death."""
    order = W.partitionBy(*PLAYER).orderBy("idx")
    nxt = [F.lead(c).over(order) for c in ("idx", "x", "y")]
    stays = F.coalesce(nxt[0] == F.col("idx") + 1, F.lit(False))
    way = (nxt[1] - F.col("x")) * (nxt[1] - F.col("x")) + (nxt[2] - F.col("y")) * (nxt[2] - F.col("y"))
    event = F.when(stays, way > rules.respawn_m**2).otherwise(F.col("idx") < F.col("n") - 1)
    ahead = order.rangeBetween(0, rules.steps(rules.fight_grace_s))
    return grid.withColumn("_event", event.cast("int")).withColumn("died", F.max("_event").over(ahead) == 1).drop("_event")


def falls(grid: DataFrame, rules: Rules) -> DataFrame:
    """(server_id, player_id, idx, n): the steps from which a player is gone, or jumps. The window's end is no death."""
    order = W.partitionBy(*PLAYER).orderBy("idx")
    nxt = [F.lead(c).over(order) for c in ("idx", "x", "y")]
    way = (nxt[1] - F.col("x")) * (nxt[1] - F.col("x")) + (nxt[2] - F.col("y")) * (nxt[2] - F.col("y"))
    event = F.when(F.coalesce(nxt[0] == F.col("idx") + 1, F.lit(False)), way > rules.respawn_m**2).otherwise(F.col("idx") < F.col("n") - 1)
    return grid.withColumn("_event", event).filter("_event").select(*PLAYER, "idx", "n")


def dying(grid: DataFrame, rules: Rules) -> DataFrame:
    """(server_id, player_id, idx, n): every step, present or not, from which the player dies within fight_grace_s."""
    rows = falls(grid, rules)
    span = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("idx") - rules.steps(rules.fight_grace_s)), F.col("idx"))
    return rows.select(*PLAYER, "n", F.explode(span).alias("idx")).distinct()


def who_dies(rows: DataFrame, fallen: DataFrame, rules: Rules, who: str, step: str, key: list[str]) -> DataFrame:
    """The keys of rows from whose step a player dies within fight_grace_s. The few rows look for the falls, which don't
    become all the steps before them."""
    grace = rules.steps(rules.fight_grace_s)
    fell = fallen.select("server_id", F.col("player_id").alias(who), F.col("idx").alias("_fell"), F.expr(f"idx div {grace + 1}").alias("_b"))
    rows = rows.select(*dict.fromkeys(["server_id", who, step, *key]))
    rows = rows.withColumn("_b", F.explode(F.array(F.expr(f"{step} div {grace + 1}"), F.expr(f"{step} div {grace + 1} + 1"))))
    rows = rows.join(fell, ["server_id", who, "_b"]).filter((F.col("_fell") >= F.col(step)) & (F.col("_fell") <= F.col(step) + grace))
    return rows.select(*key).distinct()


def _usable(shifts: list[int]):
    """Of time shifts in steps those that fit in half of a server's n steps."""
    return F.filter(F.array(*[F.lit(s).cast("long") for s in shifts]), lambda s: s <= F.expr("n div 2"))


def shifted(grid: DataFrame, rules: Rules, real: bool = True, null: bool = True) -> DataFrame:
    """Every row at each usable time shift (0 is the real one), cyclic in the server's n steps."""
    all_ = [0] * real + [rules.steps(s) for s in rules.null_shifts_s] * null
    return grid.withColumn("shift", F.explode(_usable(all_))).withColumn("idx", F.pmod(F.col("idx") + F.col("shift"), F.col("n")))


def at_shifts(rows: DataFrame, rules: Rules) -> DataFrame:
    """Every row at each usable time shift, with the step (then) at which others stood who are moved to its idx: the same
    pairs as with the others `shifted`, but it is the fewer rows that are copied."""
    return before_shift(rows.withColumn("shift", F.explode(_usable([0, *map(rules.steps, rules.null_shifts_s)]))))


def at_each_shift(rows: DataFrame, rules: Rules) -> DataFrame:
    """Every row at each usable time shift, 0 too, and by how many steps (_off) others are moved on then, cyclic in the n steps:
    it is the few rows that are copied, not the tracks of the others."""
    rows = rows.withColumn("shift", F.explode(_usable([0, *map(rules.steps, rules.null_shifts_s)])))
    return rows.withColumn("_off", F.explode(F.array("shift", F.col("shift") - F.col("n"))))


def before_shift(rows: DataFrame, step: str = "idx", name: str = "then") -> DataFrame:
    """Adds the step from which the shift of a row moves others to one of its steps."""
    return rows.withColumn(name, F.pmod(F.col(step) - F.col("shift"), F.col("n")))


def n_shifts(n, rules: Rules):
    """How many of the time shifts a server of n steps can use."""
    return sum(F.when(F.lit(rules.steps(s)) <= F.floor(n / 2), 1).otherwise(0) for s in rules.null_shifts_s)


def pairs(mine: DataFrame, others: DataFrame, ordered: bool = False) -> DataFrame:
    """Rows of i beside rows of j at the same place of the grid: columns of mine as they are, of others with suffix _j."""
    right = others.select("server_id", "idx", *[F.col(c).alias(f"{c}_j") for c in others.columns if c not in ("server_id", "idx", "shift", "n")], *(["shift"] if "shift" in others.columns else []))
    rows = mine.join(right, ["server_id", "idx"])
    return rows.filter(F.col("player_id") < F.col("player_id_j")) if ordered else rows.filter(F.col("player_id") != F.col("player_id_j"))


def square(a: str = "x", b: str = "y"):
    """Squared distance between i and j."""
    return (F.col(f"{a}_j") - F.col(a)) * (F.col(f"{a}_j") - F.col(a)) + (F.col(f"{b}_j") - F.col(b)) * (F.col(f"{b}_j") - F.col(b))


def by_step(rows: DataFrame, *columns: str) -> DataFrame:
    """(server_id, idx, all): who is on a server at a step, with some of their columns; dealt once, not once for each side of a pair.
    Steps of dealt pieces, which have their _block, are there already."""
    block = ["_block"] if "_block" in rows.columns else []
    return rows.groupBy("server_id", *block, "idx").agg(F.collect_list(F.struct("player_id", *columns)).alias("all"))


#: Radii to the side of a cell in `close`: rows near a border are copied, (1 + 2 / CELL)^2 rows for each on average.
CELL = 6


def close(mine: DataFrame, others: DataFrame, radius: float, ordered: bool = False) -> DataFrame:
    """As pairs, of those within the radius only: rows meet in large cells, into which those within the radius of their
    borders are copied."""
    side, reach = float(radius) * CELL, float(radius) * (1 + 1e-9)
    cell = lambda c: F.floor(c / F.lit(side)).cast("long")
    left = mine.withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
    touched = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    right = others.withColumn("_cx", touched("x")).withColumn("_cy", touched("y"))
    right = right.select("server_id", "idx", "_cx", "_cy", *[F.col(c).alias(f"{c}_j") for c in others.columns if c not in ("server_id", "idx", "shift", "n")], *(["shift"] if "shift" in others.columns else []))
    rows = left.join(right, ["server_id", "idx", "_cx", "_cy"]).drop("_cx", "_cy").filter(square() <= radius * radius)
    return rows.filter(F.col("player_id") < F.col("player_id_j")) if ordered else rows.filter(F.col("player_id") != F.col("player_id_j"))


def islands(rows: DataFrame, keys: tuple, bridge: int = 0, extra: tuple = ()) -> DataFrame:
    """Runs of consecutive idx by key, gaps of up to `bridge` steps filled: (keys, run_start, run_end) and aggregates."""
    order = W.partitionBy(*keys).orderBy("idx")
    new = F.coalesce(F.col("idx") - F.lag("idx").over(order) - 1 > bridge, F.lit(True)).cast("int")
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return rows.groupBy(*keys, "_run").agg(F.min("idx").alias("run_start"), F.max("idx").alias("run_end"), *extra).drop("_run")


def joined(runs: DataFrame, keys: tuple, bridge: int, extra: tuple = ()) -> DataFrame:
    """Runs made from parts of them (keys, run_start, run_end) that lie up to `bridge` steps apart, and aggregates."""
    order = W.partitionBy(*keys).orderBy("run_start")
    before = F.max("run_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("run_start") - before - 1 > bridge, F.lit(True)).cast("int")
    rows = runs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    ends = [F.min("run_start").alias("_s"), F.max("run_end").alias("_e")]
    rows = rows.groupBy(*keys, "_run").agg(*ends, *extra).drop("_run")
    return rows.withColumnsRenamed({"_s": "run_start", "_e": "run_end"})


# The same steps in SQL: common table expressions over the positions of sources/events.py, with max_gap_s 300.
SQL = """
span AS (SELECT server_id, min(t) AS t0, (max(t) - min(t)) // 5 + 1 AS n FROM pos GROUP BY 1 HAVING max(t) > min(t)),
ld AS (SELECT pos.*, t0, n, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pos JOIN span USING (server_id) WINDOW w AS (PARTITION BY server_id, player_id ORDER BY t)),
lx AS (SELECT *, unnest(generate_series(CAST(ceil((t - t0) / 5.0) AS BIGINT), CASE WHEN t1 - t <= 300 THEN CAST(ceil((t1 - t0) / 5.0) AS BIGINT) - 1 ELSE CAST(floor((t - t0) / 5.0) AS BIGINT) END)) AS idx FROM ld),
grid AS (SELECT server_id, player_id, idx,
         CASE WHEN t1 - t <= 300 THEN (x1 - x) / CAST(t1 - t AS DOUBLE) * ((t0 + idx * 5.0::DOUBLE) - t) + x ELSE x END AS x,
         CASE WHEN t1 - t <= 300 THEN (y1 - y) / CAST(t1 - t AS DOUBLE) * ((t0 + idx * 5.0::DOUBLE) - t) + y ELSE y END AS y,
         dino_class, CASE WHEN dino_class = 'purchase' THEN 900.0::DOUBLE ELSE 300.0::DOUBLE END AS aware, n FROM lx)"""
HEAD_SQL = """
hd AS (SELECT *, max(x) OVER a - x AS dx, max(y) OVER a - y AS dy FROM grid WINDOW a AS (PARTITION BY server_id, player_id ORDER BY idx RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING)),
head AS (SELECT *, coalesce(dx * dx + dy * dy >= 506.25, false) AS moving FROM hd)"""
DEATH_SQL = """
de AS (SELECT *, CAST(CASE WHEN lead(idx) OVER w = idx + 1 THEN (lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y) > 90000 ELSE idx < n - 1 END AS INTEGER) AS event
       FROM grid WINDOW w AS (PARTITION BY server_id, player_id ORDER BY idx)),
dead AS (SELECT *, max(event) OVER (PARTITION BY server_id, player_id ORDER BY idx RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING) = 1 AS died FROM de)"""
