from pyspark.sql import functions as F

from spindrift.sources import events as logs
from spindrift.streaming import events as S

SCHEMA = "event_id long, session_id long, ts timestamp, action string, step_order int, output string"


def test_step_sessions(spark, tmp_path):
    rows = [
        (1, 1, "2024-01-01 10:00:00", "step", 1, "one"),
        (2, 1, "2024-01-01 10:01:00", "step", 2, "two"),
        (3, 1, "2024-01-01 10:02:00", "complete", 0, None),
        (4, 1, "2024-01-01 10:03:00", "step", 9, "late"),
        (5, 2, "2024-01-01 10:00:00", "step", 1, "\n".join(map(str, range(20)))),
        (6, 3, "2024-01-01 10:00:00", "abort", 0, None),
    ]
    frame = spark.createDataFrame(rows, "event_id long, session_id long, ts string, action string, step_order int, output string").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = {r["session_id"]: r for r in S.run_available(S.step_sessions(stream), "own_sessions", str(tmp_path / "state"), "update").collect()}
    assert (got[1]["status"], got[1]["current_step"]) == ("completed", 2)
    assert got[2]["status"] == "active" and got[2]["context"].splitlines() == [str(i) for i in range(12, 20)]
    assert got[3]["status"] == "aborted"


def test_duplicates_across_files(spark, tmp_path):
    one = spark.range(5).select(F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(1.0).alias("value"))
    logs.emit(one, str(tmp_path / "spool"))
    logs.emit(one, str(tmp_path / "spool"))
    stream = logs.stream_spool(spark, str(tmp_path / "spool"), "event_id long, ts timestamp, value double", 1)
    assert S.run_available(S.deduplicated(stream), "own_dedupe", str(tmp_path / "state")).count() == 5


def test_a_late_event_leaves_no_state_behind(spark, tmp_path):
    """Files in turn: a session that completes, a late event of it, and one of another a week later, by which the first has left."""
    kind = "event_id long, session_id long, ts timestamp, action string, step_order int, output string"
    days = [("2024-01-01 10:00:00", 1, "complete"), ("2024-01-01 10:05:00", 1, "step"), ("2024-01-09 10:00:00", 2, "step"), ("2024-01-10 10:00:00", 2, "step")]
    for i, (ts, session, action) in enumerate(days):
        row = spark.createDataFrame([(i, session, ts, action, 1, "x")], "event_id long, session_id long, ts string, action string, step_order int, output string")
        row.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = S.step_sessions(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
