"""Exact top-k by inner product: a KD-tree per shard, searched best first with box bounds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import QUERIES, SHARD, kth, meet, one_per_id, packed, ranked, top_merge, valid
from .common import partitions, table

K = 5
SCALE = 256
LEAF = 64
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
LOWEST = -(1 << 63)


def scaled(data):
    import numpy as np

    return np.floor(data * SCALE)


def tree(ids, data):
    """A shard: ids and vectors in the order of the leaves, the tight box of every node, and where each leaf begins.

    Median splits along the widest side. Node n has children 2n+1 and 2n+2; all leaves are on the last level.
    """
    import numpy as np

    data = scaled(data)
    depth = max(0, int(np.ceil(np.log2(max(1, len(data)) / LEAF))))
    count = 2 ** (depth + 1) - 1
    rows: list = [np.arange(len(data))] + [None] * (count - 1)
    low, high = np.zeros((count, data.shape[1])), np.zeros((count, data.shape[1]))
    for node in range(count):
        mine = rows[node]
        if len(mine):
            low[node], high[node] = data[mine].min(axis=0), data[mine].max(axis=0)
        if 2 * node + 1 < count:
            half = len(mine) // 2
            order = np.argpartition(data[mine, int((high[node] - low[node]).argmax())], half) if len(mine) > 1 else np.arange(len(mine))
            rows[2 * node + 1], rows[2 * node + 2] = mine[order[:half]], mine[order[half:]]
    leaves = rows[count // 2 :]
    order = np.concatenate(leaves)
    return ids[order], data[order], low, high, np.cumsum([0, *map(len, leaves)])


class Search:
    """A group of query blocks, shard after shard, with the kth score carried from each to the next."""

    def __init__(self, blocks: list, k: int, whole: bool):
        import numpy as np

        self.k, self.whole = k, whole
        none = (np.zeros(0, dtype=np.int64),) * 3
        self.parts = [[ids, scaled(data), none] for ids, data in blocks]

    def scores(self, data, query):
        """Integer scores; beyond what doubles hold exactly in Python's integers, and an error beyond 64 bits."""
        import numpy as np

        if self.whole:
            return (data @ query).astype(np.int64)
        ints = [int(x) for x in query.tolist()]
        return np.array([sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in data.tolist()], dtype=np.int64)

    def step(self, ids, data, low, high, begin) -> None:
        import heapq

        import numpy as np

        leaf = len(low) // 2
        full = np.ones(len(low), dtype=bool)
        full[leaf:] = np.diff(begin) > 0
        for part in self.parts:
            query_ids, queries, best = part
            bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
            if not self.whole:
                bounds += 1e-9 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)
            bounds[:, ~full] = -np.inf
            bar = kth(best, len(queries), self.k, LOWEST)
            for row in np.flatnonzero(bounds[:, 0] >= bar).tolist():
                least, query, bound = int(bar[row]), queries[row], bounds[row].tolist()
                heap, top = [(-bound[0], 0)], []
                while heap and -heap[0][0] >= least:
                    _, node = heapq.heappop(heap)
                    if node < leaf:
                        for child in (2 * node + 1, 2 * node + 2):
                            if bound[child] >= least and bound[child] > -np.inf:
                                heapq.heappush(heap, (-bound[child], child))
                        continue
                    a, b = begin[node - leaf], begin[node - leaf + 1]
                    scores = self.scores(data[a:b], query)
                    for i in np.flatnonzero(scores >= least).tolist():
                        vec = int(ids[a + i])
                        if vec != query_ids[row]:
                            heapq.heappush(top, (int(scores[i]), -vec))
                            if len(top) > self.k:
                                heapq.heappop(top)
                    if len(top) == self.k:
                        least = max(least, top[0][0])
                if top:
                    new = (np.full(len(top), row), np.array([-v for _, v in top]), np.array([s for s, _ in top]))
                    best = tuple(np.concatenate(x) for x in zip(best, new, strict=True))
            part[-1] = top_merge(best, self.k)

    def best(self) -> Iterator:
        for query_ids, _, (rows, ids, scores) in self.parts:
            yield {"query_id": query_ids[rows], "vec_id": ids, "score": scores}


def nearest(vectors: DataFrame, every: int, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, the k rows of highest integer score.

    Components become floor(256 x). Sums of products are exact in doubles up to 2^53; where vectors are longer than that,
    they are taken in Python's integers, and a score beyond 64 bits is an error. A box bounds the score of all its rows,
    so a node whose bound is below the kth score can't hold a better row; nodes at the bound are visited, as a tie may
    have a smaller id. The tree of a shard is built once. Null and non-finite vectors and null ids take no part; zero
    vectors do. Shorter vectors are filled up with zeros. Rows that share a vec_id are one query (the least vector) but
    each a candidate of other queries. Other columns are not read; an empty table gives an empty result.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = F.col("id") % every == 0
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0)))
    n, q, width, longest = rows.agg(F.count(F.lit(1)), F.count_if(asked), F.max(F.size("v")), F.max(size)).first()
    if not q:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = packed(rows, SHARD, n, width, tree)
    queries = packed(one_per_id(rows.filter(asked)), QUERIES, q, width, lambda ids, data: (ids, data))
    whole = longest < EXACT
    found = meet(queries, shards, -(-q // QUERIES), -(-n // SHARD), lambda blocks: Search(blocks, k, whole), "query_id long, vec_id long, score long", partitions(rows.sparkSession))
    return ranked(found, k)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 50)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
