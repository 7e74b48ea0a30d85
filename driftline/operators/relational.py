"""The relational part: ingest, horizons, queues, retention, flags and alerts, as DataFrame to DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .state import accumulated, numbered


def ingest(new: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a batch whose key isn't stored yet, the first of each key."""
    first = W.partitionBy(*keys).orderBy(*order)
    fresh = new.join(stored.select(*keys), keys, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with those of new in their place, and new ones added."""
    values = [c for c in old.columns if c not in keys]
    right = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_new"))
    rows = old.join(right, keys, "full")
    return rows.select(*keys, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version of each key."""
    order = W.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def horizon(rows: DataFrame, keys: list[str], end: Column, since: Column, sums: list[str], sets: tuple = ()) -> DataFrame:
    """Sums of additive evidence whose window ends after `since`, and the sorted union of comma-joined sets."""
    kept = rows.filter(end > since)
    out = [F.sum(c).alias(c) for c in sums]
    for c in sets:
        parts = F.flatten(F.collect_set(F.filter(F.split(F.col(c), ","), lambda x: x != "")))
        out.append(F.array_join(F.array_sort(F.array_distinct(parts)), ",").alias(c))
    return kept.groupBy(*keys).agg(*out)


def pending(windows: DataFrame, done: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first windows that aren't done yet."""
    return windows.select(*keys).distinct().join(done.select(*keys), keys, "left_anti").orderBy(*keys).limit(limit)


def retained(rows: DataFrame, at: str, cutoff: Column, protected: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows from the cut-off on, and older ones that something still refers to."""
    if protected is None:
        return rows.filter(F.col(at) >= cutoff)
    held = protected.select(F.col(key)).distinct().withColumn("_held", F.lit(True))
    return rows.join(held, key, "left").filter((F.col(at) >= cutoff) | F.col("_held")).drop("_held")


def bounded_queue(rows: DataFrame, keys: list[str], order: str, size: str, most: int) -> DataFrame:
    """The newest rows of each queue whose sizes fit in `most` together: the oldest are dropped."""
    back = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_b", F.sum(size).over(back)).filter(F.col("_b") <= most).drop("_b")


def rejoins(sightings: DataFrame, keys: list[str], at: str, gap_s: float, seeds: DataFrame | None = None) -> DataFrame:
    """Sightings at least gap_s after the one before, the first of each key included.

    With seeds (keys, last_seen), what came up to then has been dealt with, and the first one after is compared with it.
    """
    before = F.lag(at).over(W.partitionBy(*keys).orderBy(at))
    if seeds is not None:
        sightings = sightings.join(seeds, keys, "left").filter(F.col("last_seen").isNull() | (F.col(at) > F.col("last_seen")))
        before = F.coalesce(before, F.col("last_seen"))
    rows = sightings.withColumn("gap_s", F.col(at) - before).filter(F.col("gap_s").isNull() | (F.col("gap_s") >= gap_s))
    return rows if seeds is None else rows.drop("last_seen")


def apply_flags(scores: DataFrame, flags: DataFrame, now: Column, threshold: float, suppress: Column) -> DataFrame:
    """What becomes of each player at or over the threshold: refresh an open flag, stay suppressed, or create one."""
    hot = scores.filter(F.col("score") >= threshold)
    open_ = flags.filter("status = 'open'").groupBy("player_id").agg(F.max("max_score").alias("open_max"))
    false_ = flags.filter((F.col("status") == "false_positive") & (F.col("resolved_at") >= now - suppress)).select("player_id").distinct().withColumn("_fp", F.lit(True))
    rows = hot.join(open_, "player_id", "left").join(false_, "player_id", "left")
    action = F.when(F.col("open_max").isNotNull(), "refresh").when(F.col("_fp"), "suppressed").otherwise("create")
    return rows.select("player_id", "score", action.alias("action"), F.greatest("score", F.coalesce("open_max", "score")).alias("max_score"))


def cooled_down(new: DataFrame, sent: DataFrame, key: str, at: str, wait: Column) -> DataFrame:
    """Alerts whose key had none within `wait` before."""
    last = sent.groupBy(key).agg(F.max(at).alias("_last"))
    return new.join(last, key, "left").filter(F.col("_last").isNull() | (F.col(at) - F.col("_last") >= wait)).drop("_last")


def deliveries(outbox: DataFrame, base: float, cap: float, tries: int) -> DataFrame:
    """The outbox after a round: sent, failed for good, or due again after a doubling wait."""
    from ..functions.scalars import backoff

    wait = F.greatest(backoff(F.col("attempts") + 1, base, cap), F.coalesce("retry_after", F.lit(0.0)))
    status = F.when(F.col("outcome") == "ok", "sent").when((F.col("outcome") == "permanent") | (F.col("attempts") + 1 >= tries), "failed").otherwise("pending")
    rows = outbox.withColumns({"status": status, "_wait": wait, "attempts": F.col("attempts") + 1})
    return rows.withColumn("wait_s", F.when(F.col("status") == "pending", F.col("_wait"))).drop("outcome", "retry_after", "_wait")


def auc(rows: DataFrame, score: str, label: str, by: tuple = ()) -> DataFrame:
    """(by, auc): area under the ROC curve, ties counted half: from counts per distinct score, so no pair is formed.

    With `by`, of each key on its own. Null where one of the classes is missing.
    """
    counts = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    counts = accumulated(counts, [F.col(score)], "q", "_before", by)
    won = counts.select(*by, "p", "q", (F.col("p") * (F.col("_before") + F.col("q") / 2)).alias("won"))
    return won.groupBy(*by).agg(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def quantile_higher(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value at rank ceil(p (n - 1)), counted from zero. Ranks come from range partitions, so a large key takes many tasks."""
    placed = numbered(rows.select(*keys, value), [*map(F.col, keys), F.col(value)], "_i")
    first = placed.groupBy(*keys).agg((F.min("_i") + F.ceil(F.lit(p) * (F.count(F.lit(1)) - 1))).alias("_i"))
    return placed.join(first, [*keys, "_i"]).select(*keys, value)


def block_statistics(rows: DataFrame, keys: list[str], order: list[str], value: str, size: int = 8) -> DataFrame:
    """Sums over blocks of consecutive rows, as additive statistics: n, sum g, sum g^2, sum s^2, sum s m, sum m^2."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    block = rows.withColumn("_b", F.floor((n - 1) / F.lit(size))).groupBy(*keys, "_b").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("m"), F.sum(F.col(value) * F.col(value)).alias("sq"))
    out = {"n": "m", "g": "s", "gg": "sq"}
    squares = {"ss": F.col("s") * F.col("s"), "sm": F.col("s") * F.col("m"), "mm": F.col("m") * F.col("m")}
    return block.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in out.items()], *[F.sum(c).alias(k) for k, c in squares.items()])


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each key; of equals the smallest."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def windows_with_context(rows: DataFrame, at: str, anchor: Column, length: int, context: int) -> DataFrame:
    """Each row in its window, and in the next one's leading context too: adds window_end and counted."""
    own = F.floor((F.col(at) - anchor) / length)
    near = (F.col(at) - anchor) - own * length >= length - context
    each = F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own)))
    rows = rows.withColumn("_w", each)
    return rows.withColumn("window_end", anchor + (F.col("_w") + 1) * length).withColumn("counted", F.col(at) >= anchor + F.col("_w") * length).drop("_w")


def token_bucket(calls: DataFrame, key: str, at: str, rate: float, burst: float) -> DataFrame:
    """(key, at, allowed): each call takes a token; tokens come back at `rate`, up to `burst`.

    The calls of a key stream by in their order; a task holds no more than the tokens of the key it is at. Tokens are
    counted in the seconds that they take to come back: sums of whole seconds are exact, those of shares of a token aren't.
    """
    field, cost = calls.schema[key], 1 / rate

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, credit, last = None, burst * cost, None
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is None or k != now:
                    now, credit, last = k, burst * cost, t
                credit, last = min(burst * cost, credit + (t - last)), t
                allowed.append(credit >= cost)
                credit -= cost * allowed[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], names=[key, "at", "allowed"])

    ordered = calls.select(key, F.col(at).cast("double").alias("at")).repartition(key).sortWithinPartitions(key, "at")
    return ordered.mapInArrow(run, StructType([field, StructField("at", DoubleType()), StructField("allowed", BooleanType())]))


def pair_quality(true: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of found pairs (player_a, player_b)."""
    keys = ["player_a", "player_b"]
    both = true.select(*keys, F.lit(1).alias("t")).join(found.select(*keys, F.lit(1).alias("f")), keys, "full").agg(F.count_if((F.col("t") == 1) & (F.col("f") == 1)).alias("hit"), F.count("t").alias("n_true"), F.count("f").alias("n_found"))
    p, r = F.try_divide(F.col("hit"), F.col("n_found")), F.try_divide(F.col("hit"), F.col("n_true"))
    return both.select("hit", "n_true", "n_found", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
