from glossaflow.streaming.leases import lease_stream

EVENTS = "item STRING, seq BIGINT, at DOUBLE, worker STRING, action STRING, target STRING"
ROWS = [
    ("a", 1, 0.0, "w1", "claim", None), ("a", 2, 10.0, "w2", "claim", None), ("a", 3, 20.0, "w1", "submit", " "), ("a", 4, 1800.0, "w2", "claim", None),
    ("a", 5, 1801.0, "w1", "submit", "late"), ("a", 6, 1802.0, "w2", "submit", "done"), ("a", 7, 9999.0, "w1", "claim", None),
    ("b", 1, 0.0, "w1", "claim", None), ("b", 2, 1000.0, "w1", "renew", None), ("b", 3, 2000.0, "w2", "claim", None), ("b", 4, 2001.0, "w1", "release", None), ("b", 5, 2002.0, "w2", "claim", None),
]
EXPECTED = {
    ("a", 1): "accepted", ("a", 2): "taken", ("a", 3): "empty", ("a", 4): "accepted", ("a", 5): "not leased", ("a", 6): "accepted", ("a", 7): "translated",
    ("b", 1): "accepted", ("b", 2): "accepted", ("b", 3): "taken", ("b", 4): "accepted", ("b", 5): "accepted",
}


def outcomes(df):
    return {(r["item"], r["seq"]): r["outcome"] for r in df.collect()}


def test_batch(spark):
    assert outcomes(lease_stream(spark.createDataFrame(ROWS, EVENTS))) == EXPECTED


def test_stream_in_two_micro_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for n, rows in enumerate((ROWS[:3] + ROWS[7:9], ROWS[3:7] + ROWS[9:])):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(source)
        stream = lease_stream(spark.readStream.schema(EVENTS).json(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    assert outcomes(spark.read.parquet(str(tmp_path / "out"))) == EXPECTED
