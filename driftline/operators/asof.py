"""As-of joins: for each time the sample at or before it, and the one at or after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bracketed(times: DataFrame, samples: DataFrame, keys: list[str], at: str, block: float) -> DataFrame:
    """times with `before` and `after`: structs of (at, the other columns of samples), null where there is none.

    A sample at the very time is both. Of samples of a key at one time the one with the least values counts; a null time or
    sample time brackets nothing. A key's rows are split into blocks of time, so that no task holds a long history whole;
    what a block's first rows need of earlier blocks, and its last ones of later ones, is carried as one sample a block.
    """
    values = [c for c in samples.columns if c not in keys]
    rest = [c for c in values if c != at]
    number = lambda c: F.floor(F.col(c) / F.lit(float(block))).cast("long")
    one = samples.filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.min(F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))).alias("_v"))
    one = one.select(*keys, F.col(at).alias("_t"), F.struct(F.col(at), *[F.col(f"_v.{c}").alias(c) for c in rest]).alias("_s"))
    mine = [F.struct(*[F.col(c) for c in times.columns]).alias("_row")]
    kind = times.select(*mine).schema["_row"].dataType.simpleString()
    asked = times.select(*keys, F.col(at).alias("_t"), F.lit(None).cast(one.schema["_s"].dataType).alias("_s"), *mine)
    rows = asked.unionByName(one.withColumn("_row", F.lit(None).cast(kind))).withColumn("_b", number("_t"))
    edges = rows.groupBy(*keys, "_b").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_t"))).alias("_last"), F.min_by("_s", F.when(F.col("_s").isNotNull(), F.col("_t"))).alias("_first"))
    blocks = W.partitionBy(*keys)
    up, down = blocks.orderBy("_b").rowsBetween(W.unboundedPreceding, -1), blocks.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(*keys, "_b", F.last_value("_last", F.lit(True)).over(up).alias("_earlier"), F.last_value("_first", F.lit(True)).over(down).alias("_later"))
    inside = W.partitionBy(*keys, "_b")
    peers = (W.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.last_value("_s", F.lit(True)).over(inside.orderBy("_t").rangeBetween(*peers)))
    rows = rows.withColumn("_after", F.last_value("_s", F.lit(True)).over(inside.orderBy(F.desc("_t")).rangeBetween(*peers))).filter(F.col("_row").isNotNull())
    same = [rows[k].eqNullSafe(edges[k]) for k in (*keys, "_b")]
    joined = rows.join(edges, same, "left")
    here = F.col("_t").isNotNull()
    return joined.select("_row.*", F.when(here, F.coalesce("_before", "_earlier")).alias("before"), F.when(here, F.coalesce("_after", "_later")).alias("after"))


def interpolated(name: str, at: str, max_gap: float) -> Column:
    """A value of the bracketing samples at a time: the sample's own at its time, else linear where they are near enough."""
    a, b = F.col("before"), F.col("after")
    way = (b[name] - a[name]) / F.nullif(b[at] - a[at], F.lit(0)) * (F.col(at) - a[at]) + a[name]
    return F.when(a[at] == F.col(at), a[name]).when(b[at] - a[at] <= max_gap, way)
