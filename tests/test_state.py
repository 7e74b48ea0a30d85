"""Tables in the shared folder."""

from pyspark.sql import functions as F

from driftline.operators.state import Table


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_only_small_tables_are_broadcast(spark):
    big = Table(spark.range(200_000).select("id", F.xxhash64("id").alias("v"))).df
    few = Table(spark.range(100).select("id", F.lit(1).alias("w"))).df
    wide = spark.range(10_000_000).withColumn("k", F.col("id") % 7)
    assert not broadcasts(wide.join(big.filter("v > 0").select("id"), "id"))
    assert not broadcasts(wide.join(big.groupBy("id").agg(F.max("v").alias("v")), "id", "left_anti"))
    assert broadcasts(wide.join(few, "id"))
    assert wide.join(big.filter("v > 0").select("id"), "id").count() == big.filter("v > 0").count()
