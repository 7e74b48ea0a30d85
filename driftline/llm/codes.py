"""Vector codes by product quantisation: a VA-file of every codebook's entries finds each part's nearest entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import valid
from .common import cut, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits to a coordinate's cell.
BITS = 3
#: Numbers worked out at once, about; sums of squares below ROOM are taken in 64 bits, larger ones in Python's integers.
ROOM_AT_ONCE, ROOM = 1 << 21, 1 << 59
#: A label with more than one in HOT of the rows meets its sum in a broadcast, which so has HOT rows at most.
HOT = 1000


def whole(data):
    """floor(4096 x) as 64-bit integers, or as Python's where squares of differences might not fit."""
    import numpy as np

    peak = np.abs(data).max(initial=0.0)
    if peak * SCALE < 2.0**62:
        return np.floor(data * SCALE).astype(np.int64)
    from math import floor

    return np.array([[floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE for x in row] for row in data.tolist()], dtype=object).reshape(data.shape)


class Cells:
    """The VA-file of a codebook: of each entry's coordinates the cells, and of each cell the least and greatest coordinate in it.

    Cells hold equally many entries, so that crowded stretches of a coordinate have narrow ones.
    """

    def __init__(self, entries):
        import numpy as np

        self.entries = entries
        k, d = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        rank = np.empty((k, d), dtype=np.int64)
        np.put_along_axis(rank, order, np.arange(k)[:, None], axis=0)
        n = min(1 << BITS, k)
        self.cell = (rank * n // k).astype(np.uint8)
        sorted_ = np.take_along_axis(entries, order, axis=0)
        first = -(-np.arange(n + 1) * k // n)
        self.low, self.high = sorted_[first[:-1]], sorted_[first[1:] - 1]

    def nearest(self, parts):
        """Index of the entry at the least squared distance, ties to the lower one, and that distance."""
        import numpy as np

        n, (k, d) = len(parts), self.entries.shape
        below, above = self.low - parts[:, None, :], parts[:, None, :] - self.high
        outside, across = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
        each = np.arange(d)
        lower = (outside * outside)[:, self.cell, each].sum(axis=2)
        upper = (across * across)[:, self.cell, each].sum(axis=2)
        rows, at = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        gap = parts[rows] - self.entries[at]
        exact = np.full((n, k), None if parts.dtype == object else np.iinfo(np.int64).max, dtype=parts.dtype)
        if parts.dtype == object:
            exact[:] = upper.max() + 1
        exact[rows, at] = (gap * gap).sum(axis=1)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(n), best]


def matrices(batch, column: int, width: int):
    """The vectors of a batch as integer rows, filled up with zeros, a bounded number at a time: (first row, rows)."""
    import numpy as np

    v = batch.column(column)
    counts = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    data = np.zeros((len(counts), width))
    data[np.repeat(np.arange(len(counts)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    step = max(1, ROOM_AT_ONCE // (ENTRIES * max(1, width // PARTS)))
    for a in range(0, len(data), step):
        yield a, whole(data[a : a + step])


def searched(rows, books):
    """For each part position: the parts, and index and squared distance of their nearest entries."""
    import numpy as np

    d = rows.shape[1] // PARTS
    peak = max(int(np.abs(x).max(initial=0)) for x in (rows, *books))
    if 4 * peak * peak * rows.shape[1] >= ROOM:
        rows, books = rows.astype(object), [b.astype(object) for b in books]
    for p, entries in enumerate(books):
        parts = rows[:, p * d : (p + 1) * d]
        yield parts, *Cells(entries).nearest(parts)


def kept_rows(vectors: DataFrame, *carry: str) -> DataFrame:
    """(id, v, then the columns to carry) of the vectors that take part."""
    rows = vectors.filter(valid(F.col("embedding")))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), *[F.col(c).alias(f"_{c}") for c in carry])


def moved(rows: DataFrame, books: list, width: int) -> list:
    """One round: each entry becomes the floor of the mean of the parts nearest to it; unused ones stay.

    A task sends one sum for each component of each entry, whatever its rows; the driver gets those of all entries.
    """

    def gather(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        k, d = books[0].shape
        sums, counts = np.zeros((PARTS, k, d), dtype=object), np.zeros((PARTS, k), dtype=np.int64)
        for batch in batches:
            for _, data in matrices(batch, 0, width):
                for p, (parts, best, _) in enumerate(searched(data, books)):
                    counts[p] += np.bincount(best, minlength=k)
                    order = np.argsort(best, kind="stable")
                    used, first = np.unique(best[order], return_index=True)
                    sums[p, used] += np.add.reduceat(parts[order], first, axis=0).astype(object)
        p, e, j = (x.ravel() for x in np.indices(sums.shape))
        used = np.flatnonzero(counts[p, e] > 0)
        arrays = [pa.array((p * k + e)[used], pa.int32()), pa.array(j[used], pa.int32()), pa.array(counts[p, e][used], pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([Decimal(int(x)) for x in sums.ravel()[used]], pa.decimal128(38, 0))], names=["e", "j", "n", "s"])

    found = rows.select("v").mapInArrow(gather, "e int, j int, n long, s decimal(38,0)").groupBy("e", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = [b.copy() for b in books]
    for r in found.collect():
        p, e = divmod(r["e"], len(books[0]))
        value = int(r["s"]) // r["n"]
        if abs(value) >= 1 << 62:
            new[p] = new[p].astype(object)
        new[p][e, r["j"]] = value
    return new


def fit(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list:
    """The codebook of each part position: entries x components. It starts as the parts of the first vectors by id."""
    import numpy as np

    first = [r["v"] for r in rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    start = whole(np.array([[*v, *[0.0] * (width - len(v))] for v in first]))
    books = list(np.split(start, PARTS, axis=1))
    for _ in range(rounds):
        books = moved(rows, books, width)
    return books


def encoded(rows: DataFrame, books: list, width: int) -> DataFrame:
    """(vec_id, code, error, then the carried columns): two hex digits a part, and the summed squared distances."""
    carried = rows.columns[2:]
    types = [rows.schema[c].dataType.simpleString() for c in ("id", *carried)]

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes, errors = [], []
            for _, data in matrices(batch, 1, width):
                found = [(best, gap) for _, best, gap in searched(data, books)]
                codes += [x.tobytes().hex() for x in np.stack([b for b, _ in found], axis=1).astype(np.uint8)]
                errors += sum(g.astype(object) for _, g in found).tolist()
            arrays = [batch.column(0), pa.array(codes, pa.string()), pa.array(errors, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "code", "error", *carried])

    schema = f"vec_id {types[0]}, code string, error long" + "".join(f", {c} {t}" for c, t in zip(carried, types[1:], strict=True))
    return rows.mapInArrow(encode, schema)


def digest(books: list) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all vectors that take part.

    A codebook's entries are a VA-file: their coordinates are quantised to cells of BITS bits; a part's tables of least
    and greatest squared distance to every cell bound its distance to each entry, and only entries whose lower bound
    isn't above the least upper bound are measured, in integers. Vectors null, empty or holding null or non-finite
    components take no part. Shorter vectors are filled up with zeros, and all to a multiple of PARTS. Repeated rows and
    ids are coded each, ids that are null come last; with fewer than ENTRIES vectors a codebook has as many entries as
    there are vectors. Null labels are one label. Other columns are not read; an empty table gives an empty result. An
    error beyond 64 bits, of components around 2^19 and more, can't be held in a long and raises one.
    """
    rows = kept_rows(vectors, "label")
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = -(-(longest or 1) // PARTS) * PARTS
    books = fit(rows, width) if n else []
    done = cut(encoded(rows, books, width))
    sums = cut(done.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    hot = F.broadcast(sums.filter(F.col("_n") * HOT > n))
    same = F.col("_label").eqNullSafe(F.col("_l"))
    rest = done.join(hot, same, "left_anti").join(sums.filter(F.col("_n") * HOT <= n), same)
    out = done.join(hot, same).unionByName(rest)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = """SELECT x.r, x.p, min({{'d': list_sum(list_transform(list_zip(x.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': c.k}}) AS b
              FROM x JOIN c{0} c ON x.p = c.p GROUP BY x.r, x.p"""
    steps = []
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        steps.append(f"""m{i} AS MATERIALIZED (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM (
              SELECT a.p, a.b.k AS k, j, CAST(sum(x.q[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN x ON a.r = x.r AND a.p = x.p, (SELECT unnest(range(1, (SELECT any_value(w) FROM w) + 1)) AS j)
              GROUP BY ALL) GROUP BY p, k)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON c.p = m.p AND c.k = m.k)")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT max(len(e)) // {PARTS} AS w FROM v),
x AS MATERIALIZED (SELECT r, p, list_slice(e, p * w + 1, (p + 1) * w) AS q FROM v, w, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS k, q FROM x WHERE r <= {ENTRIES}),
{", ".join(steps)},
f AS MATERIALIZED ({near.format(ROUNDS)}),
o AS (SELECT r, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h
"""


SQL = _sql()
