"""Tables that grow by whole batches: staged files, then one marker that readers honour."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "batch string, tables map<string,string>, ends map<string,double>"


@dataclass(frozen=True)
class Store:
    """A folder of tables with these schemas. `ends` of a batch says up to when it brings each org.

    A batch is written under a name of its own and shows when its marker appears, all of it at once; the marker is renamed
    into place and never over another, so of two writers one wins. A batch that is there already is left as it is. What a
    lost writer left is read by nobody, and goes with `vacuum`.
    """

    spark: SparkSession
    root: str
    schemas: dict[str, str] = field(default_factory=dict)

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _marker(self, batch: str) -> str:
        return f"{self.root}/commits/{batch}.json"

    def has(self, batch: str) -> bool:
        fs, target = self._fs(self._marker(batch))
        return fs.exists(target)

    def markers(self) -> DataFrame:
        """(batch, tables, ends) of every committed batch."""
        fs, target = self._fs(f"{self.root}/commits")
        if not fs.exists(target):
            return self.spark.createDataFrame([], MARKER)
        return self.spark.read.schema(MARKER).option("pathGlobFilter", "*.json").json(f"{self.root}/commits")

    def save(self, batch: str, tables: dict[str, DataFrame], ends: dict[str, float] | None = None) -> bool:
        """Writes a batch and commits it; False if it was there before, whoever wrote it."""
        if self.has(batch):
            return False
        attempt = uuid.uuid4().hex
        places = {name: f"data/{name}/{batch}-{attempt}" for name in tables}
        for name, rows in tables.items():
            self._written(rows, name, f"{self.root}/{places[name]}")
        return self._commit(batch, attempt, {"batch": batch, "tables": places, "ends": ends or {}})

    def _written(self, rows: DataFrame, name: str, path: str) -> None:
        rows.to(self.spark.createDataFrame([], self.schemas[name]).schema).write.option("compression", "zstd").parquet(path)

    def _commit(self, batch: str, attempt: str, marker: dict) -> bool:
        fs, draft = self._fs(f"{self.root}/commits/.{batch}-{attempt}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(marker, sort_keys=True).encode()))
        out.close()
        context = self.spark.sparkContext
        rename = getattr(context._jvm, "org.apache.hadoop.fs.Options$Rename")
        never_over = context._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
        _, target = self._fs(self._marker(batch))
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(target), never_over)
        except Exception:
            if self.has(batch):
                fs.delete(draft, False)
                return False
            raise
        return True

    def read(self, name: str, after: float | None = None) -> DataFrame:
        """The committed rows of a table; with `after`, of the batches that bring some org beyond that time only.

        Only the folders of those batches are listed and read: their names come from the markers.
        """
        rows = self.markers().filter(F.map_contains_key("tables", F.lit(name)))
        if after is not None:
            rows = rows.filter((F.cardinality("ends") == 0) | F.exists(F.map_values("ends"), lambda e: e > after))
        paths = sorted(r["p"] for r in rows.select(F.col("tables")[name].alias("p")).collect())
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.root}/{p}" for p in paths])

    def progress(self, kind: str = "") -> DataFrame:
        """(org_id, until): how far the committed batches, of a kind by their name's beginning, bring each org."""
        rows = self.markers().filter(F.col("batch").startswith(kind))
        return rows.select(F.explode("ends").alias("org_id", "end")).groupBy("org_id").agg(F.max("end").alias("until"))

    def scratch(self) -> None:
        """Lets the whole store go when the session ends."""
        fs, target = self._fs(self.root)
        fs.deleteOnExit(target)

    def vacuum(self) -> int:
        """Deletes what no marker names, for when no writer is at work; the number of folders that went."""
        named = {p for r in self.markers().collect() for p in r["tables"].values()}
        gone = 0
        fs, data = self._fs(f"{self.root}/data")
        for table in fs.listStatus(data) if fs.exists(data) else ():
            for folder in fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{folder.getPath().getName()}" not in named:
                    gone += fs.delete(folder.getPath(), True)
        return gone
