"""Approximate nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what is rescored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import QUERIES, SHARD, kth, meet, one_per_id, packed, ranked, top_merge, valid
from .common import partitions, table

K = 20
#: Width of the error bound in standard deviations of an estimate, and the seed of the rotation.
SIGMAS, SEED = 4.0, 11
#: Bits of a code for each component of a vector, and of a rotated query's component.
BITS, LEVELS = 4, 4
#: Added to the error bound for the rounding of floating-point numbers.
ROUNDING = 1e-9
#: Queries whose codes are compared at once.
ROWS = 64


@cache
def rotation(width: int, seed: int = SEED):
    """Orthonormal rows that turn a vector of `width` components into one of BITS times as many, in whole 64-bit words."""
    import numpy as np

    size = 64 * -(-BITS * width // 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))
    return (q * np.sign(np.diag(r))).T


def encode(ids, data):
    """A shard: ids, packed sign bits of the rotated unit vectors, length, the code's inner product with its vector, vectors."""
    import numpy as np

    norms = np.linalg.norm(data, axis=1)
    turned = (data / norms[:, None]) @ rotation(data.shape[1])
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return ids, codes, norms, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]), data


def quantised(data):
    """A query block: unit queries, rotated, in LEVELS bit planes: (planes, offset, step, sum), so that turned ~ offset + step x level."""
    import numpy as np

    lengths = np.linalg.norm(data, axis=1)
    turned = (data / lengths[:, None]) @ rotation(data.shape[1])
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**LEVELS - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = [np.packbits(level >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(LEVELS)]
    return planes, low, step, turned.sum(axis=1), lengths


def estimates(query, codes, own):
    """Inner products of unit vectors with unit queries, from bits alone, and their standard deviations (as to the code's error)."""
    import numpy as np

    planes, low, step, total, _ = query
    size = codes.shape[1] * 64
    hits = np.zeros((len(low), len(codes)), dtype=np.uint32)
    for j, plane in enumerate(planes):
        for w in range(codes.shape[1]):
            hits += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.uint32) << np.uint32(j)
    ones = np.bitwise_count(codes).sum(axis=1)
    inner = 2 * (low[:, None] * ones + step[:, None] * hits) - total[:, None]
    code_error = np.maximum(0.0, 1 - own**2) / max(1, size - 1)
    return inner / np.sqrt(size) / own, np.sqrt(code_error + step[:, None] ** 2 / 12) / own


class Search:
    """A group of query blocks: estimates from bits, bounds, exact scores of what may be among the k best."""

    def __init__(self, blocks: list, k: int):
        import numpy as np

        self.k, self.parts = k, []
        for ids, data in blocks:
            for a in range(0, len(ids), ROWS):
                mine = data[a : a + ROWS]
                none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
                self.parts.append([ids[a : a + ROWS], mine, quantised(mine), none])

    def step(self, ids, codes, norms, own, data) -> None:
        import numpy as np

        for part in self.parts:
            query_ids, queries, query, best = part
            lengths = query[-1]
            middle, error = estimates(query, codes, own)
            middle *= norms
            high = (middle + (SIGMAS * error + ROUNDING) * norms) * lengths[:, None]
            other = ids[None, :] != query_ids[:, None]
            least = kth(best, len(queries), self.k, -np.inf)
            may = other & (high >= least[:, None])
            new = np.nonzero(np.isneginf(least))[0]
            if len(ids) > self.k and len(new):
                picks = np.argpartition(np.where(other[new], -middle[new], np.inf), self.k - 1, axis=1)[:, : self.k]
                others = np.take_along_axis(other[new], picks, axis=1)
                bar = np.where(others, np.einsum("ij,ikj->ik", queries[new], data[picks]), -np.inf).min(axis=1)
                may[new] &= high[new] >= bar[:, None]
                may[new[:, None], picks] = others
            rows, columns = np.nonzero(may)
            for a in range(0, len(rows), 1 << 16):
                r, c = rows[a : a + (1 << 16)], columns[a : a + (1 << 16)]
                scores = np.einsum("ij,ij->i", queries[r], data[c])
                fit = scores >= kth(best, len(queries), self.k, -np.inf)[r]
                best = top_merge(tuple(np.concatenate(x) for x in zip(best, (r[fit], ids[c[fit]], scores[fit]), strict=True)), self.k)
            part[-1] = best

    def best(self) -> Iterator:
        for query_ids, _, _, (rows, ids, scores) in self.parts:
            yield {"query_id": query_ids[rows], "vec_id": ids, "score": scores}


def neighbours(vectors: DataFrame, every: int, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, the k rows of largest inner product found.

    Every row is encoded once, where its shard is made. Bits and correction scalars of a candidate give an estimate whose
    error is bounded by SIGMAS deviations; only candidates whose upper bound reaches the kth exact score so far are
    scored exactly, in double precision. While a query has no kth score, the k candidates of highest estimate are scored
    first and always kept as candidates, so each query gets k rows where the table has them. Null, zero and non-finite
    vectors take no part; shorter ones are filled up with zeros; a null vec_id takes no part. Rows that share a vec_id
    are one query (the least vector) but each a candidate of other queries. Ties go to the smaller id. Other columns are
    not read; an empty table gives an empty result. Scores are exact, what is found may rarely miss one (see the tests
    for the recall).
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = F.col("id") % every == 0
    n, q, width = rows.agg(F.count(F.lit(1)), F.count_if(asked), F.max(F.size("v"))).first()
    if not q:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = packed(rows, SHARD, n, width, encode)
    queries = packed(one_per_id(rows.filter(asked)), QUERIES, q, width, lambda ids, data: (ids, data))
    found = meet(queries, shards, -(-q // QUERIES), -(-n // SHARD), lambda blocks: Search(blocks, k), "query_id long, vec_id long, score double", partitions(rows.sparkSession))
    return ranked(found, k)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), 20)
