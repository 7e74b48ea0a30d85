"""Nearest approaches of tracks at any times, from their pieces, two blocks of steps of a server at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .grid import PLAYER, Pieces

#: Steps of a block, of which every two of a server meet; of a part of a piece whose box is looked at; point pairs worked out at once.
BLOCK, PART, AT_ONCE = 480, 8, 1 << 20
SCHEMA = "server_id string, player_id string, player_id_j string, distance2 double"
ARROW = {"server_id": pa.string(), "player_id": pa.string(), "player_id_j": pa.string(), "distance2": pa.float64()}


def nearest_approach(tracks: Pieces, radius: float, most: int) -> DataFrame:
    """(server_id, player_id, player_id_j, distance2): who ever came how near to where a player ever was, within the radius, at
    any times; the nearest `most` of each player.

    Every two blocks of steps of a server meet, each time within a task, so a group is as large for a server of any length;
    what is dealt is pieces, as often as the server has blocks. Points that aren't finite take no part.
    """
    tracks = replace(tracks, block=BLOCK)
    last = F.expr(f"(n - 1) div {BLOCK}")
    rows = tracks.blocks().withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumns({"_first": F.least("_block", "_with"), "_second": F.greatest("_block", "_with")})
    keys = ("server_id", "_first", "_second")
    rows = rows.select(*keys, "player_id", "_block", "t0", "t", "x", "y", "vx", "vy", "a", "b", "off")
    rows = rows.repartition(*([tracks.parts] if tracks.parts else []), *keys)
    near = rows.groupBy(*keys).applyInArrow(block_pairs(tracks.rules.step_s, radius), SCHEMA)
    near = near.groupBy(*PLAYER, "player_id_j").agg(F.min("distance2").alias("distance2"))
    both = F.explode(F.array(F.struct("player_id", "player_id_j"), F.struct(F.col("player_id_j").alias("player_id"), F.col("player_id").alias("player_id_j"))))
    near = near.select("server_id", both.alias("_p"), "distance2").select("server_id", "_p.*", "distance2")
    order = W.partitionBy(*PLAYER).orderBy("distance2", "player_id_j")
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def block_pairs(dt: float, radius: float) -> Callable:
    """A function of the keys (server_id, _first, _second) and the pieces of both blocks: the least squared distance within
    the radius of each two players, once a pair, of points in one block to points in the other.

    Parts of pieces whose boxes are further apart than some points of the two players are can't hold the least.
    """
    limit = float(radius) * float(radius)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        server, first, second = (v.as_py() for v in key)
        names, who = np.unique(np.array(table.column("player_id").to_pylist(), dtype=str), return_inverse=True)
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        a, off = get("a").astype(np.int64), get("off").astype(np.int64)
        long = get("b").astype(np.int64) - a + 1
        piece = np.repeat(np.arange(len(a)), long)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(long) - long, long)
        then = (a - off)[piece] + nth
        v = {c: get(c).astype(float) for c in ("t0", "t", "x", "y", "vx", "vy")}
        x, y = (v[f"v{c}"][piece] * (v["t0"][piece] + then * dt - v["t"][piece]) + v[c][piece] for c in "xy")
        fine = np.isfinite(x) & np.isfinite(y)
        block = get("_block")

        def parts(b: int) -> tuple[np.ndarray, ...]:
            """Of the block: its points by player and part; of each part the player, the first point, the number, and the box."""
            at = np.nonzero(fine & (block[piece] == b))[0]
            at = at[np.lexsort((nth[at], piece[at], who[piece[at]]))]
            part = np.stack([piece[at], nth[at] // PART])
            new = np.ones(len(at), dtype=bool)
            new[1:] = (part[:, 1:] != part[:, :-1]).any(axis=0)
            head = np.nonzero(new)[0]
            px, py = x[at], y[at]
            box = [f.reduceat(p, head) for p in (px, py) for f in (np.minimum, np.maximum)] if len(at) else [px, px, py, py]
            return px, py, who[piece[at]][head], head, np.diff(np.append(head, len(at))), box

        best = np.full((len(names), len(names)), np.inf)
        px, py, pw, ph, pn, pbox = parts(first)
        qx, qy, qw, qh, qn, qbox = (px, py, pw, ph, pn, pbox) if first == second else parts(second)
        if len(pw) and len(qw):
            heads = np.nonzero(np.append(True, qw[1:] != qw[:-1]))[0]
            there = qw[heads]
            for i in np.unique(pw):
                p = np.nonzero(pw == i)[0]
                gap = [np.maximum(0, np.maximum(qbox[k][None] - pbox[k + 1][p, None], pbox[k][p, None] - qbox[k + 1][None])) for k in (0, 2)]
                low = (gap[0] * gap[0] + gap[1] * gap[1]) * (1 - 1e-9)
                sx, sy = qx[qh][None] - px[ph[p]][:, None], qy[qh][None] - py[ph[p]][:, None]
                some = np.full(len(names), np.inf)
                some[there] = np.minimum.reduceat((sx * sx + sy * sy).min(axis=0), heads)
                some = np.minimum(some, limit)
                some[i] = -1
                if first == second:
                    some[:i] = -1
                u, w = np.nonzero(low <= some[qw][None])
                for u_, w_ in _cut(p[u], w, pn, qn):
                    size = pn[u_] * qn[w_]
                    pair = np.repeat(np.arange(len(u_)), size)
                    k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
                    one, two = ph[u_][pair] + k // qn[w_][pair], qh[w_][pair] + k % qn[w_][pair]
                    dx, dy = qx[two] - px[one], qy[two] - py[one]
                    least = np.minimum.reduceat(dx * dx + dy * dy, np.cumsum(size) - size)
                    np.minimum.at(best, (np.minimum(i, qw[w_]), np.maximum(i, qw[w_])), least)
        i, j = np.nonzero(best <= limit)
        return pa.table({"server_id": pa.array([server] * len(i), pa.string()), "player_id": pa.array(names[i].tolist(), pa.string()), "player_id_j": pa.array(names[j].tolist(), pa.string()), "distance2": pa.array(best[i, j])}) if len(i) else pa.table({c: pa.array([], t) for c, t in ARROW.items()})

    return run


def _cut(u: np.ndarray, w: np.ndarray, pn: np.ndarray, qn: np.ndarray):
    """Pairs of parts, as many at once as make a bounded number of point pairs."""
    which = np.cumsum(pn[u] * qn[w]) // AT_ONCE
    for at in np.split(np.arange(len(u)), np.nonzero(np.diff(which))[0] + 1):
        if len(at):
            yield u[at], w[at]
