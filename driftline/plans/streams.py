"""Queries of operators that work on streams or between two tables of times."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import asof as J
from ..operators.state import Table, shared_folder
from ..queries import SQL, events, on_events, query
from ..streaming import stateful as S

#: Batches that a table is replayed in.
BATCHES = 4


def replayed(spark, rows, at: str, operator):
    """What an operator on streams makes of a table, which arrives in batches in the order of its times."""
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows = Table(rows).df
    cuts = rows.agg(F.percentile(at, F.array(*[F.lit(k / BATCHES) for k in range(1, BATCHES)]))).first()[0] or []
    part = sum((F.when(F.col(at) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(BATCHES):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    before = {k: spark.conf.get(k, None) for k in S.PROVIDER}
    for k, v in S.PROVIDER.items():
        spark.conf.set(k, v)
    try:
        stream = operator(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(SQL["w15_rejoins"])
def st6_rejoin_stream(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.col("s").cast("double").alias("s"))
    found = replayed(spark, rows, "s", lambda r: S.rejoins(r, ["user_id"], "s", 21600.0))
    return found.select("user_id", F.col("s").cast("long").alias("s"), F.coalesce(F.col("gap_s").cast("long"), F.lit(-1)).alias("gap_s"))


@query(SQL["f21_token_bucket"])
def st10_bucket_stream(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.col("s").cast("double").alias("at"))
    return replayed(spark, rows, "at", lambda r: S.token_bucket(r, ["user_id"], "at", 1 / 43_200, 2.0)).select("user_id", "at", "allowed")


@query(on_events("""SELECT q.event_id, b.s AS before_s, b.value AS before_value, a.s AS after_s, a.value AS after_value FROM q ASOF LEFT JOIN v b ON q.user_id = b.user_id AND q.s >= b.s ASOF LEFT JOIN v a ON q.user_id = a.user_id AND q.s <= a.s""", "q AS (SELECT event_id, user_id, s FROM e WHERE event_type <> 'view')", "v AS (SELECT user_id, s, min(value) AS value FROM e WHERE event_type = 'view' GROUP BY 1, 2)"))
def j3_bracketing(spark, sf_dir):
    """For every event that is no view, its user's last view up to then and first view from then on."""
    e = events(spark, sf_dir)
    views = e.filter("event_type = 'view'").select("user_id", "s", "value")
    rows = J.bracketed(e.filter("event_type <> 'view'").select("event_id", "user_id", "s"), views, ["user_id"], "s", 86_400.0)
    return rows.select("event_id", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in ("s", "value")])
