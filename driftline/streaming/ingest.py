"""Ingest as a stream: late and early rows are turned away, repeated ones dropped, windows counted once complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def accepted(snapshots: DataFrame, at: str, now, oldest_s: int = 14 * 86_400, ahead_s: int = 300) -> DataFrame:
    """Rows captured neither too long ago nor in the future."""
    return snapshots.filter(F.col(at).between(now - F.make_dt_interval(secs=F.lit(oldest_s)), now + F.make_dt_interval(secs=F.lit(ahead_s))))


def deduplicated(snapshots: DataFrame, keys: list[str], at: str, delay: str = "14 days") -> DataFrame:
    """The first row of each key; state for a key is kept for the delay."""
    return snapshots.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windows(rows: DataFrame, at: str, keys: list[str], length: str = "2 hours", anchor: str = "0 seconds", delay: str = "5 minutes") -> DataFrame:
    """Rows per tumbling window, given out when the watermark has passed its end; later rows are not counted."""
    frame = F.window(at, length, length, anchor)
    return rows.withWatermark(at, delay).groupBy(frame, *keys).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.end").alias("window_end"), *keys, "rows")


def write_windows(rows: DataFrame, path: str, checkpoint: str, end: str = "window_end") -> StreamingQuery:
    """Writes each window's partition anew, so a batch that runs again leaves the same files; stops when all is read."""

    def write(batch: DataFrame, _: int) -> None:
        dated = batch.withColumn("part", F.date_format(end, "yyyyMMdd'T'HHmmss"))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
