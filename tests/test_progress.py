import time

from pyspark.sql import functions as F

from glossaflow.streaming import progress


def waited(test, seconds=20):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.2)
    return test()


def test_streams_leave_records(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "runs")
    spark.range(5).write.parquet(source)
    listener = progress.ProgressRecords(spark, kept, every=0.0)
    spark.streams.addListener(listener)
    stream = spark.readStream.schema("id BIGINT").parquet(source)
    try:
        stream.writeStream.format("noop").queryName("fine").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination()
        broken = stream.select(F.raise_error(F.lit("lost")).alias("x")).writeStream.format("noop").queryName("broken").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
        try:
            broken.awaitTermination()
        except Exception:
            pass
        running = stream.writeStream.format("noop").queryName("open").option("checkpointLocation", str(tmp_path / "c")).start()
        of = lambda: {r["name"]: r for r in progress.records(spark, kept).collect()}
        assert waited(lambda: len(of()) == 3 and of()["fine"]["state"] == "complete" and of()["broken"]["state"] == "failed" and of()["open"]["rows"] == 5)
    finally:
        spark.streams.removeListener(listener)  # the driver is gone: nobody tells that the query has stopped
    running.stop()
    assert (of()["fine"]["rows"], of()["fine"]["error"]) == (5, None) and "lost" in of()["broken"]["error"]
    now = of()["open"]["updated"]
    states = lambda at: {r["name"]: r["state"] for r in progress.snapshot(spark, kept, at).collect()}
    assert states(now + 1) == {"fine": "complete", "broken": "failed", "open": "running"}
    assert states(now + 31)["open"] == "interrupted"
    assert progress.snapshot(spark, kept, now + 1).first()["name"] == "open"
    (tmp_path / "runs" / "other.json").write_text("no record")
    assert len(of()) == 3
    for _ in range(2):
        listener.files.write(f"{kept}/x.json", b"{}")


def test_heartbeats_keep_their_distance(spark, tmp_path):
    now = [100.0]
    listener = progress.ProgressRecords(spark, str(tmp_path), every=2.0, clock=lambda: now[0])
    listener._keep("r", True, name="n")
    for at, expected in ((101.0, 100.0), (102.0, 102.0), (103.5, 102.0), (104.5, 104.5)):
        now[0] = at
        listener._keep("r", batches=int(at))
        assert progress.records(spark, str(tmp_path)).first()["updated"] == expected
