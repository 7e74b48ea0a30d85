"""Operators whose state outlives a batch: rejoins after an absence, and token buckets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

#: Where state is kept; what the operators here need.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Keyed(StatefulProcessor):
    """Rows of a key in the order of their time within a batch; a key that isn't heard of for `forget_s` is forgotten.

    Its timer is moved along with every row: the watermark has to pass it, so what is forgotten doesn't depend on how rows
    fall into batches, only whether it has been forgotten yet.
    """

    def __init__(self, keys: list[str], at: str, forget_s: float, schema: str):
        self.keys, self.at, self.forget_s, self.schema = keys, at, forget_s, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        state = self.state.get() if self.state.exists() else None
        state, out = self.step(state, batch)
        self.keep(state)
        if len(out):
            yield out

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.keep(self.seeded(row))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.state.clear()
        return iter(())

    def keep(self, state: tuple) -> None:
        self.state.update(state)
        if self.forget_s:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((state[0] + self.forget_s) * 1000))

    def close(self) -> None:
        pass


class _Rejoins(_Keyed):
    """State: when the key was last seen."""

    gap_s = 0.0

    def seeded(self, row) -> tuple:
        return (float(row["last_seen"]),)

    def step(self, state, batch):
        last, gaps = state[0] if state else None, []
        for t in batch[self.at].tolist():
            gaps.append(None if last is None else t - last)
            last = t if last is None else max(last, t)
        batch = batch.assign(gap_s=gaps).astype({"gap_s": "float64"})
        return (last,), batch[batch["gap_s"].isna() | (batch["gap_s"] >= self.gap_s)]


class _Bucket(_Keyed):
    """State: the time of the last call, and the tokens left after it, in the seconds that they take to come back: sums of
    whole seconds are exact, those of shares of a token aren't."""

    rate, burst = 1.0, 1.0

    def step(self, state, batch):
        cost = 1 / self.rate
        last, credit = state if state else (None, self.burst * cost)
        allowed, waits = [], []
        for t in batch[self.at].tolist():
            credit = min(self.burst * cost, credit + max(0.0, t - (t if last is None else last)))
            last = t if last is None else max(last, t)
            allowed.append(credit >= cost)
            waits.append(0.0 if allowed[-1] else cost - credit)
            credit -= cost * allowed[-1]
        return (last, credit), batch.assign(allowed=allowed, wait_s=waits)


def _run(rows: DataFrame, processor: _Keyed, extra: list, delay_s: float, seeds: DataFrame | None = None) -> DataFrame:
    timed = rows
    mode = "None"
    if processor.forget_s:
        timed, mode = rows.withColumn("_at", F.timestamp_seconds(processor.at)).withWatermark("_at", f"{int(delay_s)} seconds"), "eventTime"
    schema = StructType([*rows.schema.fields, *extra])
    initial = seeds.groupBy(*processor.keys) if seeds is not None else None
    return timed.groupBy(*processor.keys).transformWithStateInPandas(processor, schema, "Append", mode, initial)


def rejoins(sightings: DataFrame, keys: list[str], at: str, gap_s: float, forget_s: float = 0.0, delay_s: float = 300.0, seeds: DataFrame | None = None) -> DataFrame:
    """Sightings of a stream at least gap_s after the one before of the same key, whenever that came; the first one too.

    `at` is in seconds. seeds (keys, last_seen) say who was seen before the stream began. One that comes too late to be the
    newest changes nothing and is no rejoin. With forget_s, state goes that long after the last sighting.
    """
    processor = _Rejoins(keys, at, forget_s, "last_seen double")
    processor.gap_s = gap_s
    return _run(sightings, processor, [StructField("gap_s", DoubleType())], delay_s, seeds)


def token_bucket(calls: DataFrame, keys: list[str], at: str, rate: float, burst: float, forget_s: float = 0.0, delay_s: float = 300.0) -> DataFrame:
    """Adds allowed and wait_s, the seconds until there is a token: each call takes one, they come back at `rate` up to `burst`.

    Tokens are kept across batches and restarts. A key that is forgotten starts full again, as it would be by then: forget_s
    has to be burst / rate at least.
    """
    if forget_s and forget_s < burst / rate:
        raise ValueError("a bucket must be kept until it is full again")
    processor = _Bucket(keys, at, forget_s, "at double, credit double")
    processor.rate, processor.burst = float(rate), float(burst)
    return _run(calls, processor, [StructField("allowed", BooleanType()), StructField("wait_s", DoubleType())], delay_s)
