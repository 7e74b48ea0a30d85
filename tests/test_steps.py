"""Pairs of a step, and of shifted steps, without copying the grid more than needed."""

from pyspark.sql import functions as F

from driftline.operators import evidence as E
from driftline.operators import grid as G
from driftline.operators import samples as M
from driftline.operators import tracks as T
from driftline.rules import Rules

RULES = Rules(step_s=5.0, null_shifts_s=(20.0, 40.0))


def tracks(spark):
    """Five players on two servers of 23 and 10 steps, not always there."""
    rows = spark.range(23 * 10).select((F.col("id") % 10).alias("p"), F.floor(F.col("id") / 10).alias("idx")).filter("(p + idx) % 4 > 0 and (p < 5 or idx < 10)")
    x, y = (F.col("p") * 37 + F.col("idx") * 5) % 90, (F.col("p") * 13 + F.col("idx") * 11) % 70
    return rows.select(F.when(F.col("p") < 5, "a").otherwise("b").alias("server_id"), F.concat(F.lit("u"), "p").alias("player_id"), "idx", x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(60.0).alias("aware"), F.lit("c").alias("dino_class"), F.when(F.col("p") < 5, 23).otherwise(10).cast("long").alias("n"))


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_nearest_of_a_step_without_sorting_pairs(spark):
    df = T.tracking(G.headings(tracks(spark), RULES))
    assert "SortAggregate" not in plan(df) and "Join" not in plan(df)


def test_shifting_the_fewer_rows_gives_the_same_pairs(spark):
    grid = tracks(spark)
    few, others = grid.filter("player_id in ('u1', 'u7')"), grid.select("server_id", "idx", "player_id", "x", "y", "n")
    want = G.pairs(few, G.shifted(others, RULES)).select("server_id", "shift", "player_id", "player_id_j", "idx", "x_j", "y_j")
    there = others.select("server_id", F.col("idx").alias("then"), *[F.col(c).alias(f"{c}_j") for c in ("player_id", "x", "y")])
    got = G.at_shifts(few, RULES).join(there, ["server_id", "then"]).filter("player_id <> player_id_j").select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and {r["shift"] for r in got.collect()} == {0, 4, 8}


def test_counts_of_known_steps_equal_the_steps(spark):
    grid = tracks(spark)
    friends = E.both_orders(spark.createDataFrame([("a", "u0", "u1")], "server_id string, player_id string, player_id_j string"))
    keys = ["server_id", "player_id", "player_id_j"]
    want = M.known_to_others(grid, friends, RULES).groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.min("idx").alias("first"))
    got = M.known_steps(grid, friends, RULES)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect()) and got.count() > 0
