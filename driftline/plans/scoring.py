"""Queries that score whole windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import job as J
from ..operators import window as V
from ..operators.relational import mode
from ..operators.state import Table, shared_folder
from ..operators.store import Store
from ..queries import query, samples, tracks
from ..rules import EVENT_RULES as R


def midway(spark, sf_dir):
    """The pieces of the tracks, and the step in the middle of each server's grid from which evidence counts."""
    pieces = tracks(spark, sf_dir).kept()
    return pieces, pieces.rows.select("server_id", F.expr("n div 2").alias("count_from")).distinct()


@query()
def x11_extract_evidence(spark, sf_dir):
    """Evidence of the second half of each server's time, the first half being context, in stages."""
    pieces, since = midway(spark, sf_dir)
    ev = V.extract(None, R, since, tracks=pieces)
    keys = ["server_id", "player_id"]
    return ev.players.join(ev.beeline, keys, "left").join(ev.ambush, keys, "left").join(ev.clans, "player_id", "left")


@query()
def x28_score_window(spark, sf_dir):
    pieces, since = midway(spark, sf_dir)
    return V.score_window(None, R, since, tracks=pieces)


@query()
def x30_run(spark, sf_dir):
    """A run for every org (the servers are split among three), into a store of its own: windows due, players scored, new flags."""
    rows = samples(spark, sf_dir).withColumn("org_id", F.concat(F.lit("o"), F.pmod(F.crc32("server_id"), F.lit(3)))).withColumn("t", F.col("t").cast("double"))
    rows = Table(rows).df
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", J.SCHEMAS)
    store.scratch()
    now = rows.agg(F.max("t")).first()[0]
    return J.run_scoring(store, rows, R, float(now or 0), lag_s=60.0, window_s=3000.0, strict=True)


@query()
def x29_evaluation(spark, sf_dir):
    """First-window and accumulated scores by the class a player is seen in most, over windows that carry pairs and clans on."""
    rows = Table(samples(spark, sf_dir).withColumn("org_id", F.lit("o")).withColumn("t", F.col("t").cast("double"))).df
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", J.SCHEMAS)
    store.scratch()
    kinds = mode(rows, ["player_id"], "dino_class").select("player_id", F.col("dino_class").alias("kind"))
    scores, _ = J.evaluate(store, rows, R, window_s=3000.0)
    return scores.join(kinds, "player_id").groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.max("score").alias("most"), F.count_if("flagged").alias("flagged"))
