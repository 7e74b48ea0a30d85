import datetime

from pyspark.sql import functions as F

from driftline.streaming import ingest

T0 = datetime.datetime(2026, 1, 1)


def rows(spark, path, minutes, first=0):
    data = [(first + i, "s", T0 + datetime.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    spark.createDataFrame(data, "snapshot_id long, server_id string, captured_at timestamp").coalesce(1).write.mode("append").parquet(path)


def test_windows_are_written_once_and_late_rows_left_out(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows(spark, source, [0, 10, 130, 140])

    def run():
        stream = spark.readStream.schema("snapshot_id long, server_id string, captured_at timestamp").parquet(source)
        ingest.write_windows(ingest.windows(stream, "captured_at", ["server_id"]), out, mark).awaitTermination()

    run()
    rows(spark, source, [300, 20, 310], 10)
    run()
    got = {(r["window_end"], r["rows"]) for r in spark.read.parquet(out).collect()}
    hours = lambda h: T0 + datetime.timedelta(hours=h)
    assert (hours(2), 2) in got and (hours(4), 2) in got


def test_repeated_snapshots_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, source, [0, 1])
    rows(spark, source, [0, 1])
    stream = spark.readStream.schema("snapshot_id long, server_id string, captured_at timestamp").parquet(source)
    q = ingest.deduplicated(stream, ["server_id", "snapshot_id"], "captured_at").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 2


def test_rows_from_the_future_are_turned_away(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, source, [0, 4, 6])
    kept = ingest.accepted(spark.read.parquet(source), "captured_at", F.lit(T0))
    assert kept.count() == 2
