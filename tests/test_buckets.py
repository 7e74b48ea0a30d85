"""Token buckets at the very second at which a token is back."""

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline import plans as Q

#: 43,200 seconds a token: shares of a token, added up over these, come to less than the one that is back at the end.
TIMES = (0, 0, 1409, 28684, 43200, 43200)


@pytest.mark.parametrize("name", ["f21_token_bucket", "st10_bucket_stream"])
def test_a_token_is_back_after_exactly_its_time(spark, tmp_path, name):
    calls = spark.createDataFrame([(i, 7, "view", 1.0, t) for i, t in enumerate(TIMES)], "event_id long, user_id long, event_type string, value double, s long")
    calls.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").write.parquet(f"{tmp_path}/events.parquet")
    want = [(7, float(t), k) for t, k in zip(TIMES, (True, True, False, False, False, True), strict=True)]
    assert sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect())) == want
    with duckdb.connect() as db:
        db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        assert sorted(db.sql(Q.SQL[name]).fetchall()) == want
