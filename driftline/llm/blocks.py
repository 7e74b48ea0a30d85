"""Queries against all rows, in blocks: every task holds a group of query blocks while a run of shards streams by."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows to a shard and to a query block, about; query blocks that a task holds at once.
SHARD, QUERIES, GROUP = 4096, 1024, 64


def valid(vector: Column) -> Column:
    """True for a vector that isn't null or empty and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def packed(rows: DataFrame, size: int, total: int, width: int, prepare) -> DataFrame:
    """(n, blob): rows of (id, v array<double>) dealt by a hash of the id, about `size` to a block, and prepared once.

    Equal vectors spread over all blocks. prepare(ids, matrix) gives the arrays of a block, in the order of the ids;
    shorter vectors are filled up with zeros.
    """
    n = max(1, -(-total // size))

    def pack(keys, rows):
        import numpy as np
        import pyarrow as pa

        ids, data = [], []
        for batch in rows.to_batches():
            v = batch.column(1)
            counts = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            matrix = np.zeros((len(counts), width))
            matrix[np.repeat(np.arange(len(counts)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            data.append(matrix)
        ids, data = np.concatenate(ids), np.concatenate(data)
        order = np.lexsort((*data.T[:1], ids))
        blob = pickle.dumps(prepare(ids[order], data[order]), protocol=5)
        return pa.Table.from_arrays([pa.array([keys[0].as_py()], pa.int64()), pa.array([blob])], names=["n", "blob"])

    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n)).alias("n"))
    return dealt.groupBy("n").applyInArrow(pack, "n long, blob binary")


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of the rows that share an id, the one with the least vector: an id is one query."""
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def meet(queries: DataFrame, shards: DataFrame, n_queries: int, n_shards: int, search, schema: str, tasks: int) -> DataFrame:
    """Runs a search where groups of query blocks meet runs of shards: search(query blocks).step(shard), then .best().

    A group of GROUP query blocks goes to every lane, a shard to one lane of every group: a task holds one group and one
    shard at a time. As lanes are no more than `tasks`, what is shuffled grows in proportion to the rows, as long as the
    queries fit one group; from there on each further group costs one more pass of the shards.
    """
    groups, lanes = max(1, -(-n_queries // GROUP)), max(1, min(n_shards, tasks))
    left = queries.select("n", "blob", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.expr(f"cast(n div {GROUP} as int)").alias("g"))
    right = shards.select("n", "blob", F.lit(1).alias("kind"), (F.col("n") % lanes).cast("int").alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    rows = left.unionByName(right).repartitionById(groups * lanes, (F.col("g") * lanes + F.col("lane")).cast("int"))
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        blocks, work = [], None
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                arrays = pickle.loads(blob.as_buffer())
                if kind == 0:
                    blocks.append(arrays)
                    continue
                work = work or search(blocks)
                work.step(*arrays)
        for found in work.best() if work else ():
            yield pa.RecordBatch.from_arrays([pa.array(found[n], pa.int64() if t == "long" else pa.float64()) for n, t in fields], names=[n for n, _ in fields])

    return rows.sortWithinPartitions("g", "lane", "kind", "n").select("kind", "blob").mapInArrow(run, schema)


def top_merge(best, k: int):
    """Keeps the k best of (query row, id, score) arrays by query: score down, then id up."""
    import numpy as np

    rows, ids, scores = best
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def kth(best, n: int, k: int, lowest):
    """The kth score of each query row so far; `lowest` where there are fewer."""
    import numpy as np

    rows, _, scores = best
    out = np.full(n, lowest, dtype=scores.dtype)
    first = np.searchsorted(rows, np.arange(n))
    full = np.searchsorted(rows, np.arange(n), side="right") - first >= k
    out[full] = scores[first[full] + k - 1]
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best over all lanes; each lane has sent k at most."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))))
    rows = found.groupBy("query_id").agg(F.slice(best, 1, k).alias("best")).select("query_id", F.posexplode("best").alias("p", "x"))
    return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
