"""Runs of steps at which a player heads for another, worked out a block of steps of a server at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..rules import Rules

#: Steps of a block. Runs that may go on beyond it come out as parts.
BLOCK = 240
SCHEMA = "server_id string, shift long, player_id string, player_id_j string, run_start long, run_end long, d0 double, aware0 double, n long, arrival long, whole boolean"
ARROW = {"server_id": pa.string(), "shift": pa.int64(), "player_id": pa.string(), "player_id_j": pa.string(), "run_start": pa.int64(), "run_end": pa.int64(), "d0": pa.float64(), "aware0": pa.float64(), "n": pa.int64(), "arrival": pa.int64(), "whole": pa.bool_()}


def block_runs(rules: Rules, steps: int) -> Callable:
    """A function of the keys (server_id, _block), the headed pieces of the movers, and the pieces of all at every shift, each
    cut to the block of so many steps: rows of SCHEMA.

    `whole` runs lie within the block with what may follow them: of these only those come out that count and arrive. Of
    the others the parts come out, with the squared distance and the range at their first step. What is not a number is
    greater than all numbers, as in SQL.
    """
    k, dt = rules.steps(rules.heading_s), rules.step_s
    least, bridge, tail = (rules.steps(s) for s in (rules.aligned_min_s, rules.bridge_s, rules.arrive_grace_s))
    margin = max(bridge, tail)

    def run(key: tuple, movers: pa.Table, everyone: pa.Table) -> pa.Table:
        server, block = (v.as_py() for v in key)
        begin = block * steps
        if not movers.num_rows or not everyone.num_rows:
            return pa.table({c: pa.array([], t) for c, t in ARROW.items()})

        def columns(table: pa.Table) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
            """The numbers of the pieces; and of their steps the piece, the step and the column in the block."""
            get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
            v = {c: get(c).astype(float) for c in table.column_names if c not in ("server_id", "player_id", "_block", "a", "b", "n", "shift", "off")}
            a, off = get("a").astype(np.int64), get("off").astype(np.int64)
            long = get("b").astype(np.int64) - a + 1
            piece = np.repeat(np.arange(len(a)), long)
            idx = a[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(long) - long, long)
            return v, piece, idx - off[piece], idx - begin

        def at(v: dict, c: str, piece: np.ndarray, then: np.ndarray, end: str = "") -> np.ndarray:
            return v[f"v{c}{end}"][piece] * (v["t0"][piece] + then * dt - v[f"t{end}"][piece]) + v[f"{c}{end}"][piece]

        names, who = np.unique(np.array(everyone.column("player_id").to_pylist(), dtype=str), return_inverse=True)
        shifts, moved = np.unique(everyone.column("shift").to_numpy(), return_inverse=True)
        n = everyone.column("n")[0].as_py()
        here = np.zeros((len(shifts), len(names), steps), dtype=bool)
        x, y = np.zeros(here.shape), np.zeros(here.shape)
        v, piece, then, t = columns(everyone)
        place = (moved[piece], who[piece], t)
        here[place], x[place], y[place] = True, at(v, "x", piece, then), at(v, "y", piece, then)
        real = int(np.searchsorted(shifts, 0))
        aware = np.zeros(here.shape[1:])
        mine = moved[piece] == real
        aware[who[piece][mine], t[mine]] = v["aware"][piece][mine]
        # where movers go, of those that move
        v, piece, then, t = columns(movers)
        mover = np.searchsorted(names, np.array(movers.column("player_id").to_pylist(), dtype=str))[piece]
        way = [at(v, c, piece, then + k, "_h") - at(v, c, piece, then) for c in "xy"]
        moving = ~(way[0] * way[0] + way[1] * way[1] < (rules.min_speed * k * dt) ** 2)
        dx, dy, moves = np.zeros(aware.shape), np.zeros(aware.shape), np.zeros(aware.shape, dtype=bool)
        dx[mover[moving], t[moving]], dy[mover[moving], t[moving]], moves[mover[moving], t[moving]] = way[0][moving], way[1][moving], True

        x, y, here = (m.reshape(-1, steps) for m in (x, y, here))
        other = np.arange(len(x)) % len(names)
        out = []
        for i in np.nonzero(moves.any(axis=1))[0]:
            me = real * len(names) + i
            rx, ry = x - x[me], y - y[me]
            d = rx * rx + ry * ry
            both = here & here[me]
            both[other == i] = False
            ahead = ~(rx * dx[i] + ry * dy[i] < rules.aligned_cos * np.sqrt(d * (dx[i] * dx[i] + dy[i] * dy[i])))
            j, t = np.nonzero(both & moves[i] & ahead & ~(d <= 0))
            if not len(j):
                continue
            new = np.ones(len(j), dtype=bool)
            new[1:] = (j[1:] != j[:-1]) | (t[1:] - t[:-1] - 1 > bridge)
            first = np.nonzero(new)[0]
            last = np.append(first[1:], len(j)) - 1
            j, start, end = j[first], t[first], t[last]
            d0, a0 = d[j, start], aware[i, start]
            counts = ~(d0 <= a0 * a0) & (d0 <= rules.max_start_m**2) & (end - start + 1 >= least)
            whole = (start > bridge) & (steps - 1 - end > margin)
            kept = np.nonzero(~whole | counts)[0]
            j, start, end, d0, a0, whole = (m[kept] for m in (j, start, end, d0, a0, whole))
            arrival = np.full(len(kept), -1)
            if len(w := np.nonzero(whole)[0]):
                long = end[w] + tail - start[w] + 1
                heads = np.cumsum(long) - long
                flat = np.repeat(np.arange(len(w)), long)
                t = start[w][flat] + np.arange(len(flat)) - heads[flat]
                there, dist = both[j[w][flat], t], d[j[w][flat], t]
                far = np.add.reduceat((there & (t <= end[w][flat]) & ~(dist <= aware[i, t] * aware[i, t])).astype(np.int64), heads)
                came = np.minimum.reduceat(np.where(there & (dist <= rules.arrive_m**2), t, steps), heads)
                arrival[w] = np.where((far >= least) & (came < steps), came + begin, -1)
            kept = np.nonzero(~whole | (arrival >= 0))[0]
            if len(kept):
                out.append((np.full(len(kept), i), *(m[kept] for m in (j, start + begin, end + begin, d0, a0, arrival, whole))))
        if not out:
            return pa.table({c: pa.array([], t) for c, t in ARROW.items()})
        i, j, start, end, d0, a0, arrival, whole = (np.concatenate(m) for m in zip(*out, strict=True))
        named = lambda m: pa.array(names[m].tolist(), pa.string())
        rows = [pa.array([server] * len(i), pa.string()), pa.array(shifts[j // len(names)], pa.int64()), named(i), named(other[j]), pa.array(start), pa.array(end), pa.array(d0), pa.array(a0), pa.array(np.full(len(i), n)), pa.array(arrival, mask=arrival < 0), pa.array(whole)]
        return pa.table(dict(zip(ARROW, rows, strict=True)))

    return run
