"""SimHash near-duplicates: fingerprints, covering hash tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, cut, numbers, table

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Buckets of up to so many fingerprints are compared at once; larger ones meet through shared neighbours instead.
SMALL = 16
#: A fingerprint is joined by broadcast if it has more than one in so many of all rows.
LARGE = 1000
#: Rounds of label propagation after which components count as faulty.
ROUNDS = 60


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash) of each row, the fingerprint as a signed long; a null or wordless text has 0."""

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as digest

        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for row, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().lower().split()
                if not words:
                    continue
                line = b" ".join(words)
                if len(words) <= shingle:
                    values = [digest(line, SEED)]
                else:
                    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
                    starts = [0, *ends[: -shingle].tolist()]
                    values = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
                counts = np.zeros(64, dtype=np.int64)
                hashes = np.array(values, dtype="<u8")
                for a in range(0, len(hashes), 8192):
                    bits = np.unpackbits(hashes[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    counts += bits.sum(axis=0, dtype=np.int64)
                out[row] = weights[counts * 2 > len(hashes)].sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text")).mapInArrow(hashed, "doc_id long, fp long, text_hash long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks of which, for any `radius` positions, one keeps none.

    Position i has the vector 1 + i mod (2^(radius+1) - 1) over GF(2); the mask of v keeps the positions whose vector
    isn't orthogonal to v. Up to `radius` vectors never span the space, so some v is orthogonal to all of them.
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % n) & v).count("1") % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """(a, b): distinct fingerprints within RADIUS, enough of them to connect all that are linked by any.

    Two that differ in 2 bits or fewer fall together under one of the masks. Members of a bucket differ only in the
    positions its mask drops, so they are within 2 just if they share a value at most one such flip from both. In
    small buckets pairs are compared; in others each member meets the smallest with that value, a star of true links
    (all that share a value are within 2 of each other), so a large group makes no pairs.
    """
    masks = covering_masks()
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]))
    rows = prints.select("fp", tables.alias("x")).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).filter("n > 1")
    members = rows.join(sizes, ["t", "key"])
    few = members.filter(F.col("n") <= SMALL)
    together = few.groupBy("t", "key").agg(F.collect_list("fp").alias("all"))
    pairs = together.select(F.explode(F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)), lambda b: F.struct(a.alias("b"), b.alias("a")))))).alias("x"))
    pairs = pairs.select("x.a", "x.b")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    near = members.filter(F.col("n") > SMALL).select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    hubs = near.groupBy("value").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("value", "hub")
    stars = near.join(hubs, "value").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, of every node that has an edge.

    Alternates large-star and small-star rounds over the edges until they no longer change: each node links its
    larger neighbours, then its smaller ones, to the least of them. The rounds grow with the logarithm of the size.
    """
    kept = Kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(ROUNDS):
        both = kept.df.unionByName(kept.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        last, kept = kept, Kept(small)
        last.drop()
        now = kept.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return kept.df.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
        seen = now
    raise RuntimeError(f"components not settled in {ROUNDS} rounds")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, first, n, label): its smallest doc_id, its rows and the label of its component."""
    prints = cut(fingerprints(docs))
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    labels = components(links(firsts.select("fp")))
    return prints, firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row; the component is the smallest doc_id reachable by links.

    Equal fingerprints are linked and collapse before any join, so the links are between different fingerprints. Null
    and wordless texts have fingerprint 0, linked like any other. Repeated rows are answered each; a null doc_id
    counts as larger than any other. An empty table gives an empty result.
    """
    prints, groups = grouped(docs)
    least = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = groups.join(least, "label").select("fp", "n", "component_id")
    # a fingerprint with a thousandth of all rows would make a large task: there are a thousand of those at most, sent to all
    large = F.col("n") > prints.count() / LARGE
    hot = cut(ids.filter(large).select("fp", F.col("component_id").alias("hot_id")))
    rows = prints.join(F.broadcast(hot), "fp", "left")
    known = rows.filter("hot_id IS NOT NULL").select("doc_id", "fp", F.col("hot_id").alias("component_id"))
    # a component of null ids only has a null id: hot ones are then found here too
    rest = rows.filter("hot_id IS NULL").join(ids.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    return known.unionByName(rest)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with the smallest id; null ids come last.

    Of rows that share that id the one with the least hash of its text stays. Ids need not be there or differ: components
    are told apart by their labels, and rows are found again by id and hash. Null and wordless texts are one component;
    columns of any name come back unchanged; an empty table gives an empty one.
    """
    prints, groups = grouped(docs)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    least = prints.groupBy("fp").agg(F.min(order).alias("k"))
    kept = least.join(groups.select("fp", "label"), "fp").groupBy("label").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__kept"))
    at = {c: F.col(f"_c_{i}") for i, c in enumerate(docs.columns)}
    rows = docs.select(*numbers(docs.columns)).withColumn("__hash", F.xxhash64(at["text"]))
    rows = rows.join(kept, at["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__kept")), "left_semi")
    first = Window.partitionBy(at["doc_id"], "__hash").orderBy(at["text"])
    return rows.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").select(*[c.alias(n) for n, c in at.items()])
