"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/driftline-shared"


_open: ContextVar[list | None] = ContextVar("_open", default=None)


@contextmanager
def scope() -> Iterator[None]:
    """Drops, when it ends, the tables that were made within it on this thread: what comes of them has to be written by then."""
    made: list[Table] = []
    token = _open.set(made)
    try:
        yield
    finally:
        _open.reset(token)
        for table in made:
            table.drop()


#: Bytes of files from which on a table's rows aren't broadcast.
BROADCAST = 256 << 10


class Table:
    """A DataFrame written to the shared folder and read again: a lost executor costs a reread.

    Its files say little of its rows: tracks take less than a byte a value there, and Spark would send what it takes for a
    few MB, but is hundreds, through the driver to all. So joins of a table that isn't small are sort-merge joins.
    """

    def __init__(self, df: DataFrame):
        context = df.sparkSession.sparkContext
        self.path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self._path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(context._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        rows = df.sparkSession.read.schema(df.schema).parquet(self.path)
        self.df = rows.hint("merge") if self._fs.getContentSummary(self._path).getLength() > BROADCAST else rows
        if (made := _open.get()) is not None:
            made.append(self)

    def drop(self) -> None:
        self._fs.delete(self._path, True)


def cut(df: DataFrame) -> DataFrame:
    return Table(df).df


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in sorted range partitions, written, with the partition (_part) and the place in it (_row)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() % (1 << 33)))


def _starts(sums: dict, zero: Column) -> Column:
    """Of each partition, what the partitions before it sum up to."""
    starts, total = [], 0
    for part in range(max(sums, default=0) + 1):
        starts.append(F.lit(total) + zero)
        total += sums.get(part, 0)
    return F.element_at(F.array(*starts), F.col("_part") + 1)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place in the order, from 0. Rows equal in the order get neighbouring places, whichever.

    Range partitions are sorted and written; only their sizes, a number for each, go through the driver.
    """
    kept = _ranges(df, order)
    sizes = {r["_part"]: r["count"] for r in kept.groupBy("_part").count().collect()}
    return kept.withColumn(name, _starts(sizes, F.lit(0).cast("long")) + F.col("_row")).drop("_part", "_row")


def accumulated(df: DataFrame, order: list[Column], value: str, name: str, keys: tuple = ()) -> DataFrame:
    """Adds the sum of a number over all rows before each in the order, with keys of those with the same keys, in the same way.

    A key of many rows spreads over many range partitions. What a partition begins with is the sum so far of the one key
    that reaches into it: through the driver goes a row for each partition.
    """
    kept = _ranges(df, [*map(F.col, keys), *order])
    spark = df.sparkSession
    parts = kept.groupBy("_part", *keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias("s"), F.max("_row").alias("_last"))
    ends = parts.groupBy("_part").agg(F.max_by(F.struct(*keys, "s"), "_last").alias("e")).select("_part", "e.*").orderBy("_part")
    carries, key, total = [], None, 0
    for r in ends.collect():
        own = tuple(r[k] for k in keys)
        if key is not None:
            carries.append((r["_part"], *key, total))
        key, total = own, (total if own == key else 0) + r["s"]
    before = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = kept.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    fields = [StructField("_p", kept.schema["_part"].dataType), *[StructField(f"_k{i}", kept.schema[k].dataType) for i, k in enumerate(keys)], StructField("_carry", ends.schema["s"].dataType)]
    held = spark.createDataFrame(carries, StructType(fields))
    same = [rows["_part"] == held["_p"], *[rows[k].eqNullSafe(held[f"_k{i}"]) for i, k in enumerate(keys)]]
    out = rows.join(held, same, "left").withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0)))
    return out.drop("_part", "_row", "_p", "_carry", *[f"_k{i}" for i in range(len(keys))])
