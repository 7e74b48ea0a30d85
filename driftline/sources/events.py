"""Positions made from the events table, in integers so that any engine gets the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Range in which a class notices others; the default holds for every class not listed.
AWARENESS = {"purchase": 900.0}
AWARENESS_DEFAULT = 300.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(events: DataFrame) -> DataFrame:
    """(server_id, player_id, t, x, y, dino_class): one sample per player and second, the lowest event_id's."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 360000000")
    rows = events.select("user_id", t.alias("t"), "event_id", "event_type")
    rows = rows.groupBy("user_id", "t").agg(F.min_by("event_type", "event_id").alias("dino_class"))
    wave = lambda a, b, m: F.abs((F.lit(a) * F.col("t") + F.lit(b) * F.col("user_id")) % m - m // 2) - m // 4
    clamp = lambda c, r: F.greatest(F.lit(-r), F.least(F.lit(r), c)).cast("double")
    return rows.select(
        F.concat(F.lit("srv-"), F.expr("user_id div 15")).alias("server_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("player_id"),
        F.col("t").cast("long").alias("t"),
        clamp(wave(4, 531, 8000), 1500).alias("x"),
        clamp(wave(3, 877, 6000), 1100).alias("y"),
        "dino_class",
    )


def between(events: DataFrame, since: int, until: int) -> DataFrame:
    """Positions with t in [since, until): the limits reach the scan as limits of the time stamp."""
    at = lambda t: F.expr(f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {t * 360})")
    return positions(events.filter((F.col("ts") >= at(since)) & (F.col("ts") < at(until))))


def awareness(dino_class: Column) -> Column:
    """Metres within which the class notices others; a null class has the default."""
    out = F.lit(AWARENESS_DEFAULT)
    for name, metres in AWARENESS.items():
        out = F.when(dino_class == name, F.lit(metres)).otherwise(out)
    return out


SQL = """
ev AS (SELECT user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) // 360000000 AS t, min_by(event_type, event_id) AS dino_class FROM events GROUP BY 1, 2),
pos AS (SELECT 'srv-' || (user_id // 15) AS server_id, 'u' || user_id AS player_id, CAST(t AS BIGINT) AS t,
        CAST(greatest(-1500, least(1500, abs((4 * t + 531 * user_id) % 8000 - 4000) - 2000)) AS DOUBLE) AS x,
        CAST(greatest(-1100, least(1100, abs((3 * t + 877 * user_id) % 6000 - 3000) - 1500)) AS DOUBLE) AS y, dino_class FROM ev)"""
