from pyspark.sql import functions as F

from groundq.streaming import trace_log

SF = "/root/testdata/sf0.001"


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    for n in range(3):
        table.where(F.col("event_id") % 3 == n).write.mode("append").parquet(str(tmp_path / "in"))
    stream = trace_log.read_events(spark, str(tmp_path / "in"))
    trace_log.run_to_end(trace_log.counts_by_window(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.w.start, r.event_type): r.n for r in table.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(got) >= len(want) - 10  # the last windows are still open


def test_latest_and_once(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.union(table.limit(50)).write.parquet(str(tmp_path / "in"))
    stream = trace_log.once(trace_log.read_events(spark, str(tmp_path / "in")))
    trace_log.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.count()
    latest = trace_log.latest_by_type(trace_log.read_events(spark, str(tmp_path / "in")))
    trace_log.run_to_end(latest, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out2")).groupBy("start", "user_id", "event_type").count().where("count > 1").count() == 0
