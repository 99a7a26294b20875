from pyspark.sql import functions as F

from glossaflow.operators import listing


def test_overlay_and_precedence(spark):
    rows = [("data/A.ks", "data.xp3"), ("x/a.ks", "patch.xp3"), ("y/a.KS", "patch2.xp3"), ("z/a.ks", "patch10.xp3"), ("data/b.ks", "loose"), ("c/B.ks", "data.xp3"), ("d/b.ks", "extra.xp3")]
    entries = spark.createDataFrame(rows, "path STRING, archive STRING").withColumn("precedence", listing.archive_precedence(F.col("archive")))
    assert {r["key"]: r["archive"] for r in listing.overlay(entries).collect()} == {"a.ks": "patch10.xp3", "b.ks": "extra.xp3"}
    assert {r["key"]: r["n"] for r in listing.clashes(entries).collect()} == {"a.ks": 4, "b.ks": 3}


def test_engine_scores(spark):
    files = spark.createDataFrame([("g", "www/data/System.json"), ("g", "www/js/rpg_core.js"), ("h", "readme.txt"), ("i", "data.xp3")], "root STRING, path STRING")
    rules = spark.createDataFrame([("one", "data/System\\.json$", 60), ("one", "js/rpg_core\\.js$", 90), ("two", "\\.xp3$", 80), ("zwo", "\\.xp3$", 80)], "engine STRING, pattern STRING, score INT")
    assert [(r["root"], r["engine"], r["score"]) for r in listing.engine_scores(files, rules).collect()] == [("g", "one", 90), ("i", "zwo", 80), ("i", "two", 80)]


def test_tasks_workers_and_logs(spark):
    tasks = spark.createDataFrame([("a", "complete", 5.0, 6.0), ("b", "running", 1.0, 100.0), ("c", "running", 2.0, 10.0)], "id STRING, state STRING, started DOUBLE, updated DOUBLE")
    assert [(r["id"], r["state"]) for r in listing.task_snapshot(tasks, 30.0, 110.0).collect()] == [("b", "running"), ("a", "complete"), ("c", "interrupted")]
    batches = spark.createDataFrame([("w", n, a) for n, a in enumerate([0, 0, 5, 0, 0, 0, 1])], "worker STRING, n INT, accepted INT")
    assert [(r["streak"], r["blocked"]) for r in listing.failure_streaks(batches).orderBy("n").collect()] == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, True), (0, False)]
    lines = spark.createDataFrame([("x", '{"message": {"stopReason": "error", "t": "Rate Limit"}}'), ("y", '{"message": {"stopReason": "end", "t": "rate limit error"}}'), ("z", "ERROR: rate limit"), ("u", "rate limit")], "log STRING, line STRING")
    assert {r["log"]: r["marked"] for r in listing.log_markers(lines, ["rate limit"]).collect()} == {"x": True, "y": False, "z": True, "u": False}


def test_dictionary_round_trip(spark):
    pairs = [("b=1", "x\ny"), ("// a", "z"), ("same", "same"), ("back\\", "t\t")]
    made = listing.dictionary_file(spark.createDataFrame(pairs, "source STRING, target STRING"))
    noise = spark.createDataFrame([("// note",), ("r:x=y",), ("sr:x=y",), ("",), ("no equals",)], "value STRING")
    assert {tuple(r) for r in listing.read_dictionary(made.unionByName(noise)).collect()} == {p for p in pairs if p[0] != p[1]}
    assert [r[0] for r in listing.screen_lines(spark.createDataFrame([("あ",), ("あい",), ("ab cd",), ("a b",)], "text STRING")).collect()] == ["あい", "ab cd"]
