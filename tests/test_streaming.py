import time

from turnwright.streaming.exchanges import stream_exchanges


def test_stream_matches_the_turns(spark, tmp_path):
    schema = "CallID string, Speaker string, StartTime double, EndTime double, Transcript string, ts timestamp"
    parts = [
        [("c", "agent", 0.0, 2.0, "a"), ("c", "user", 1.5, 1.8, "u"), ("c", "user", 3.0, 4.0, "u")],
        [("c", "agent", 6.0, 8.0, "b"), ("c", "user", 6.0, 6.5, "u"), ("c", "user", 7.0, 7.5, "u"), ("c", "agent", 9.0, 10.0, "c")],
    ]
    for i, p in enumerate(parts):
        d = spark.createDataFrame(p, "CallID string, Speaker string, StartTime double, EndTime double, Transcript string").selectExpr("*", "timestamp_seconds(StartTime) as ts")
        d.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_exchanges(src, "ts").writeStream.outputMode("append").format("memory").queryName("ex").option("checkpointLocation", str(tmp_path / "cp")).start()
    end = time.time() + 120
    while spark.table("ex").count() < 2 and time.time() < end:  # waiting calls may time out at any moment, so the stream itself doesn't end
        time.sleep(0.5)
    q.stop()
    got = sorted((r.StartTime, r.NumConsecutiveUserUtterances, r.UserEndTime) for r in spark.table("ex").collect())
    assert got == [(0.0, 2, 4.0), (6.0, 1, 7.5)]
