"""Queries that read by ranges of time, and of evidence that adds up over windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import approach as A
from ..operators.grid import spans
from ..operators.state import Table, shared_folder
from ..queries import EXPORT_KEY, SQL, query, samples, spawns
from ..rules import EVENT_RULES as R
from ..sources import events as S
from ..sources import export as X

#: Seconds of the epoch at which the events begin, and how much faster positions' time runs.
BEGIN, PACE = 1_704_067_200, 360


def exported(spark, sf_dir) -> str:
    """A folder with all positions under pseudonyms, at their real times."""
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = samples(spark, sf_dir).withColumn("org_id", F.lit("o")).withColumn("t", F.col("t") * PACE + BEGIN)
    X.write(X.pseudonymous(rows, EXPORT_KEY), folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@query(f"WITH {S.SQL} SELECT CAST(to_timestamp(t * {PACE} + {BEGIN}) AT TIME ZONE 'UTC' AS DATE) AS date, dino_class, count(*) AS n, sum(x) AS sum_x FROM pos WHERE t * {PACE} + {BEGIN} >= 1704700000 AND t * {PACE} + {BEGIN} < 1705200000 GROUP BY ALL")
def s7_export_range(spark, sf_dir):
    """A range of dates, and of times within it, of an export in the shared folder."""
    rows = X.read(spark, exported(spark, sf_dir), "2024-01-08", "2024-01-14", ["date", "server", "player", "t", "x", "dino_class"], 1_704_700_000.0, 1_705_200_000.0)
    return rows.groupBy("date", "dino_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("sum_x"))


@query(f"WITH {S.SQL} SELECT server_id, player_id, t, x, y FROM pos WHERE t >= 1800 AND t < 3600")
def s5_positions_range(spark, sf_dir):
    return S.between(S.read(spark, sf_dir, "events"), 1800, 3600).select("server_id", "player_id", "t", "x", "y")


@query(SQL["x6_contact_scores"])
def a24_contact_from_windows(spark, sf_dir):
    """Contact scores from episodes counted by window (here: the halves of each server's time), then added up."""
    halves = spans(samples(spark, sf_dir), R).select("server_id", F.expr("n div 2").alias("half"))
    found = Table(spawns(spark, sf_dir).join(halves, "server_id")).df
    first, second = (A.spawn_counts(found.filter(c)) for c in ("idx < half", "idx >= half"))
    rows = A.contact_scores(A.spawn_counts(first.unionByName(second)), R)
    return rows.select("player_id", "episodes", "contacts", F.round("mean_rank", 8).alias("mean_rank"), F.round("z", 6).alias("z"), F.round("score", 6).alias("score"))
