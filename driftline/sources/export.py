"""The training export: pseudonymous positions by date, and a manifest per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import pseudonym

NARROW = ("x", "y", "z", "growth")


def pseudonymous(positions: DataFrame, key: bytes) -> DataFrame:
    """Ids replaced by keyed hashes, names left out, coordinates as floats."""
    ids = [pseudonym(kind, F.col(f"{kind}_id"), key).alias(kind) for kind in ("org", "server", "player")]
    narrow = [F.col(c).cast("float").alias(c) for c in NARROW if c in positions.columns]
    return positions.select(*ids, F.col("t").cast("double").alias("t"), *narrow, "dino_class")


def write(rows: DataFrame, path: str) -> None:
    """Parquet with zstd, a folder a date; a date written again replaces its folder."""
    dated = rows.withColumn("date", F.to_date(F.timestamp_seconds("t")))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(path)


def manifest(rows: DataFrame, window_s: int = 7200) -> DataFrame:
    """(org, window_end, rows, players, servers) of each window."""
    end = (F.floor(F.col("t") / window_s) + 1) * window_s
    return rows.groupBy("org", end.alias("window_end")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("player").alias("players"), F.countDistinct("server").alias("servers"))


def read(spark: SparkSession, path: str, first: str | None, last: str | None, columns: list[str], since: float | None = None, until: float | None = None) -> DataFrame:
    """Columns of the dates from first to last, both included, and of times in [since, until).

    Folders of other dates are not listed, columns not asked for not read, and within a file row groups of other times are
    passed over. A window that was exported twice counts once.
    """
    rows = spark.read.parquet(path)
    limits = [F.col("date") >= F.lit(first).cast("date") if first else None, F.col("date") <= F.lit(last).cast("date") if last else None]
    limits += [F.col("t") >= since if since is not None else None, F.col("t") < until if until is not None else None]
    for limit in limits:
        rows = rows if limit is None else rows.filter(limit)
    keys = [c for c in ("server", "player", "t") if c in columns]
    rows = rows.select(*columns)
    return rows.dropDuplicates(keys) if len(keys) == 3 else rows
