import random

import pytest

from glossaflow.streaming import workers


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, workers.STORE)
    yield spark
    spark.conf.set(key, before)


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def operator_rows(operator):
    return workers.LEASE_ROWS if operator is workers.worker_leases else workers.POOL_ROWS


def later(rows, schema, seconds):
    times = [i for i, c in enumerate(schema.split(", ")) if c.split()[0] in ("at", "expires", "until")]
    return [tuple(x + seconds if i in times and x is not None else x for i, x in enumerate(r)) for r in rows]


def streamed(spark, tmp_path, rows, schema, cuts, operator, **args):
    """The rows of a stream that gets the events in several micro-batches, and what is left in its state."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = later(rows, schema, 5000.0)  # a stream takes nothing at or before its watermark, which begins at 0
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").json(source)
        query = operator(spark.readStream.schema(schema).json(source), **args).writeStream.format("parquet").option("checkpointLocation", state)
        query.trigger(availableNow=True).start(target).awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "items").load(state).count()
    found = later([tuple(r) for r in spark.read.parquet(target).collect()], operator_rows(operator), -5000.0)
    return sorted(found, key=key), left


def batch(spark, rows, schema, operator, **args):
    return sorted((tuple(r) for r in operator(spark.createDataFrame(rows, schema).repartition(3), **args).collect()), key=key)


LEASES = [
    ("w", 1, 0.0, "claim", ["a", "b"]), ("w", 2, 100.0, "claim", ["c"]), ("w", 3, 200.0, "submit", ["a"]), ("w", 4, 200.0, "submit", ["a"]), ("v", 5, 300.0, "submit", ["b"]),
    ("v", 6, 400.0, "claim", []), ("v", 7, 500.0, "claim", [f"i{i}" for i in range(301)]), ("u", 8, 600.0, "claim", ["x"]), ("u", 9, 700.0, "release", None), ("v", 10, 800.0, "odd", None),
    ("w", 11, 2000.0, "submit", ["b"]), ("t", 12, 2500.0, "claim", ["q"]), ("t", 13, 2600.0, "submit", ["q"]), ("w", 14, 9000.0, "claim", ["d"]), ("w", 15, 9001.0, "submit", ["d"]),
]


def test_leases_end_without_an_event(spark):
    rows = batch(spark, LEASES, workers.LEASE_EVENTS, workers.worker_leases, late=0.0)
    said = {r[1]: r[4] for r in rows if r[1]}
    assert [said[n] for n in range(1, 16)] == ["granted", "kept", "accepted", "rejected", "rejected", "rejected", "rejected", "granted", "released", "ignored", "rejected", "granted", "accepted", "granted", "accepted"]
    assert [(r[0], r[2], r[5]) for r in rows if r[3] == "expire"] == [("w", 2000.0, "b")]


def test_a_lease_stream_equals_its_batch_and_empties_its_state(rocks, tmp_path):
    for n, cuts in enumerate(([], [4, 8], [7, 11, 13])):
        found, left = streamed(rocks, tmp_path / str(n), LEASES, workers.LEASE_EVENTS, cuts, workers.worker_leases, late=0.0)
        assert found == batch(rocks, LEASES, workers.LEASE_EVENTS, workers.worker_leases, late=0.0)
        assert left == 0


def test_the_end_comes_at_its_millisecond(rocks, tmp_path):
    rows = [("w", 1, 0.0, "claim", ["a"]), ("v", 2, 1800.0, "claim", ["b"]), ("v", 3, 3599.75, "claim", ["b"])]
    expected = batch(rocks, rows, workers.LEASE_EVENTS, workers.worker_leases, late=0.0)
    assert [r[2] for r in expected if r[3] == "expire"] == [1800.0]
    assert streamed(rocks, tmp_path, rows, workers.LEASE_EVENTS, [2], workers.worker_leases, late=0.0) == (expected, 1)


POOL = [
    ("p", "w", 1, 0.0, "start", None), ("p", "w", 2, 5.0, "finish", 0), ("p", "w", 3, 8.0, "start", None), ("p", "w", 4, 20.0, "finish", 0), ("p", "v", 5, 21.0, "limited", 3),
    ("p", "w", 6, 40.0, "start", None), ("p", "v", 7, 45.0, "limited", 0), ("p", None, 8, 50.0, "pause", None), ("p", "u", 9, 60.0, "start", None), ("p", None, 10, 70.0, "resume", None),
    ("p", "w", 11, 80.0, "finish", 0), ("p", "w", 12, 90.0, "start", None), ("p", "v", 13, 200.0, "finish", 2), ("p", "v", 14, 201.0, "drained", None), ("p", "v", 15, 202.0, "finish", 0),
    ("q", "x", 16, 300.0, "start", None), ("p", "u", 17, 301.0, "start", None), ("p", None, 18, 400.0, "stop", None), ("q", "x", 19, 500.0, "finish", 0), ("q", None, 20, 600.0, "stop", None), ("q", None, 21, 700.0, "odd", None),
]
STATES = {
    1: ("running", 0, 0), 2: ("batch_finished", 1, 0), 3: ("waiting", 1, 0), 4: ("batch_finished", 2, 0), 5: ("rate_limited", 0, 1), 6: ("global_cooldown", 2, 1), 7: ("rate_limited", 0, 2),
    8: ("paused", None, 2), 9: ("paused", 0, 2), 10: ("resumed", None, 2), 11: ("blocked", 3, 2), 12: ("blocked", 3, 2), 13: ("batch_finished", 0, 0), 14: ("complete", 0, 0), 15: ("complete", 0, 0),
    16: ("running", 0, 0), 17: ("running", 0, 0), 19: ("batch_finished", 1, 0), 21: ("ignored", None, 0),
}


def test_pools(spark):
    rows = batch(spark, POOL, workers.POOL_EVENTS, workers.worker_pools, late=0.0)
    assert {r[2]: r[4:7] for r in rows if r[2] in STATES} == STATES
    assert [(r[1], r[4]) for r in rows if r[2] == 18] == [(None, "stopped"), ("u", "cancelled")]
    # the second limit, met within the first cooldown, moves its end to 45 + 60
    assert sorted((r[3], r[1], r[4]) for r in rows if r[2] is None) == [(15.0, "w", "ready"), (30.0, "w", "ready"), (105.0, None, "cooldown_over"), (510.0, "x", "ready")]


def test_a_pool_stream_equals_its_batch(rocks, tmp_path):
    expected = batch(rocks, POOL, workers.POOL_EVENTS, workers.worker_pools, late=0.0)
    found, left = streamed(rocks, tmp_path, POOL, workers.POOL_EVENTS, [4, 8, 13], workers.worker_pools, late=0.0)
    assert found == expected and left == 0


def test_random_events_in_batch_and_stream(rocks, tmp_path):
    rng = random.Random(4)
    at, rows = 0.0, []
    for n in range(120):
        at += rng.choice([0.5, 3.0, 20.0, 700.0])
        rows.append((rng.choice("pq"), rng.choice(["a", "b", None]), n, at, rng.choice(["start", "finish", "finish", "limited", "pause", "resume", "drained", "stop"]), rng.choice([None, 0, 1])))
    expected = batch(rocks, rows, workers.POOL_EVENTS, workers.worker_pools, late=0.0)
    assert streamed(rocks, tmp_path, rows, workers.POOL_EVENTS, [40, 90], workers.worker_pools, late=0.0)[0] == expected


def test_nulls_and_empty_tables(spark):
    rows = [(None, 1, 0.0, "claim", ["a"]), ("w", 2, None, "claim", ["a"]), ("w", None, 5.0, None, None)]
    assert [r[4] for r in batch(spark, rows, workers.LEASE_EVENTS, workers.worker_leases)] == ["ignored"]
    assert batch(spark, [], workers.LEASE_EVENTS, workers.worker_leases) == []
    assert batch(spark, [], workers.POOL_EVENTS, workers.worker_pools) == []


def test_a_stream_asks_for_its_state_store(spark, tmp_path):
    spark.createDataFrame(LEASES[:1], workers.LEASE_EVENTS).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(workers.LEASE_EVENTS).json(str(tmp_path / "in"))
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != workers.STORE:
        with pytest.raises(ValueError, match="stateStore"):
            workers.worker_leases(stream)


def test_a_wait_that_ends_after_an_event_of_the_same_millisecond_is_not_over(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    # workers 0 and 20 of one pool wait until 10.0001 and 10.0003 s; 20 starts, and 0 is limited, in between
    rows = "(3, 0, 'view', 100), (6, 20, 'view', 300), (7, 20, 'signup', 10000200), (8, 0, 'error', 10000250), (9, 20, 'signup', 90000000), (10, 0, 'signup', 200000000)"
    events = f"SELECT a::BIGINT AS event_id, make_timestamp(1704067200000000 + d) AS ts, b::BIGINT AS user_id, c AS event_type, 1.0 AS value FROM (VALUES {rows}) t(a, b, c, d)"
    duckdb.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet'")
    told = duckdb.connect()
    told.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = told.execute(entry.oracle_sql()["worker_pools"]).fetchall()
    found = [tuple(r) for r in entry.queries()["worker_pools"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert ("0", "20", 7) in [r[:3] for r in found if r[4] == "waiting"]


def test_an_event_is_told_once_for_each_wait_that_it_falls_into(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    # finishes and starts of one moment, after a wait that is still open; ids that 3 divides bring nothing
    rows = "(3, 20, 'view', 0), (6, 20, 'view', 5), (7, 20, 'click', 5), (10, 20, 'signup', 5), (12, 20, 'view', 5), (13, 20, 'signup', 5), (14, 20, 'signup', 6), (15, 0, 'click', 7), (16, 0, 'view', 8), (17, 0, 'signup', 8), (18, 0, 'signup', 200)"
    events = f"SELECT a::BIGINT AS event_id, make_timestamp(1704067200000000 + d * 1000000) AS ts, b::BIGINT AS user_id, c AS event_type, 1.0 AS value FROM (VALUES {rows}) t(a, b, c, d)"
    duckdb.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet'")
    told = duckdb.connect()
    told.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = told.execute(entry.oracle_sql()["worker_pools"]).fetchall()
    found = [tuple(r) for r in entry.queries()["worker_pools"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert len([r for r in found if r[2] == 13]) == 3


def test_a_stream_keeps_the_waits_of_one_moment(rocks, tmp_path):
    rows = [("p", "w", n, at, action, accepted) for n, (at, action, accepted) in enumerate([(0.0, "finish", 0), (5.0, "finish", 0), (5.0, "finish", 1), (5.0, "finish", 0), (5.0, "start", None), (6.0, "start", None), (99.0, "start", None)])]
    expected = batch(rocks, rows, workers.POOL_EVENTS, workers.worker_pools, late=60.0)
    assert sorted(r[7] - r[3] for r in expected if r[2] == 4) == [5.0, 10.0, 10.0]
    assert streamed(rocks, tmp_path, rows, workers.POOL_EVENTS, [2, 4], workers.worker_pools, late=60.0)[0] == expected


def test_a_step_does_not_look_at_all_workers():
    class Seen(dict):
        looks = 0

        def values(self):
            Seen.looks += 1
            return super().values()

        def items(self):
            Seen.looks += 1
            return super().items()

    pool, rows = workers.Pool(), []
    pool.workers = Seen()
    for n in range(5000):
        action = "start" if n // 1000 == 1 else "finish"
        rows += pool.step({"worker": f"w{n % 1000}", "seq": n, "at": n * 0.005, "action": action, "accepted": 0})
    for at, action in ((30.0, "limited"), (100.0, "pause")):
        rows += pool.step({"worker": "v", "seq": 5000, "at": at, "action": action, "accepted": None})
    assert Seen.looks == 0
    assert {"ready", "cooldown_over", "waiting", "blocked"} <= {r[3] for r in rows}
