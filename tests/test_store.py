import pytest
from pyspark.sql import functions as F

from glossaflow.operators import catalog, store

OCC = "seq BIGINT, source STRING, surface STRING, ref STRING, context STRING, hint STRING"
FIRST = [(i, f"text {i % 12}", "s", f"r{i}", None, "display" if i % 2 else "unknown") for i in range(20)] + [(30, None, "s", "r", None, "display")]
SECOND = [(1, "text 3", "s", "r3", "newer", "excluded"), (2, "a new one", "s", "r1", None, "display")]


def frame(spark, rows, schema=OCC):
    return spark.createDataFrame(rows, schema)


def files(tmp_path):
    return sorted((str(p.relative_to(tmp_path)), p.stat().st_mtime_ns) for p in tmp_path.rglob("*.parquet"))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def stored(spark, tmp_path):
    c = store.Catalog(spark, str(tmp_path / "cat"), digits=1)
    assert c.add_occurrences("first", frame(spark, FIRST))
    return c


def test_stored_tables_equal_those_in_one_go(spark, stored):
    stored.add_occurrences("second", frame(spark, SECOND))
    whole = catalog.new_items(frame(spark, FIRST), frame(spark, [], catalog.ITEM_COLUMNS))
    whole = whole.unionByName(catalog.new_items(frame(spark, SECOND), whole))
    assert rows(stored.table("items").drop("seq")) == rows(whole.drop("seq"))
    assert [r["source"] for r in stored.table("items").orderBy("seq").collect()] == [f"text {i}" for i in range(12)] + ["a new one"]
    refs = catalog.merged_refs(frame(spark, SECOND), catalog.merged_refs(frame(spark, FIRST), frame(spark, [], catalog.REF_COLUMNS)))
    assert rows(stored.table("refs")) == rows(refs)


def test_a_batch_is_applied_once_and_leaves_other_partitions_alone(spark, stored, tmp_path):
    before = files(tmp_path)
    assert not stored.add_occurrences("first", frame(spark, FIRST)) and files(tmp_path) == before
    assert stored.add_occurrences("second", frame(spark, SECOND))
    touched = set(stored.parts_of(frame(spark, SECOND), "source"))
    kept = [f for f in before if not any(f"part={p}/" in f[0] for p in touched)]
    assert kept and len(touched) < 16 and set(kept) <= set(files(tmp_path))
    assert not store.Catalog(spark, stored.path, digits=1).add_occurrences("second", frame(spark, SECOND))


def test_a_change_that_fails_is_whole_or_nothing(spark, stored, tmp_path, monkeypatch):
    before = rows(stored.table("items"))
    bad = frame(spark, [("0" * 16, "display", "no such item", 1)], "id STRING, usage STRING, reason STRING, seq BIGINT")
    with pytest.raises(catalog.Rejected):
        stored.apply_decisions("bad", bad)
    assert rows(stored.table("items")) == before and not stored.applied("bad")
    # refs fail while the copy is written: no mark, so nothing of it holds
    broken = frame(spark, SECOND).withColumn("context", F.when(F.col("seq") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("context")))
    with pytest.raises(Exception, match="lost"):
        stored.add_occurrences("second", broken)
    assert stored.files.names(f"{stored.path}/_staged") == ["second"]
    again = store.Catalog(spark, stored.path, digits=1)
    assert rows(again.table("items")) == before and again.files.names(f"{stored.path}/_staged") == []
    # the writer dies when half of the tables have been overwritten: the next one finishes
    with monkeypatch.context() as m:
        m.setattr(store.Catalog, "_promote", lambda self, batch: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            again.add_occurrences("third", frame(spark, SECOND))
    assert rows(again.table("items")) == before
    later = store.Catalog(spark, stored.path, digits=1)
    assert later.applied("third") and later.table("items").count() == 13


def test_a_stream_brings_a_batch_twice(spark, stored, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, SECOND).coalesce(1).write.json(source)
    for state in ("one", "two"):  # a new checkpoint counts its batches from 0 again
        stream = spark.readStream.schema(OCC).json(source)
        stream.writeStream.foreachBatch(stored.sink("docs", stored.add_occurrences)).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
        now = files(tmp_path / "cat")
        assert stored.applied("docs-0")
        assert state == "one" or now == before
        before = now
    assert stored.table("items").count() == 13


def test_leases_terms_and_quarantine(spark, stored):
    batch = stored.claim("lease-1", "w1", 100.0, 3).collect()
    assert len(batch) == 3 and {r["lease"] for r in batch} == {"lease-1"}
    assert [r["id"] for r in stored.claim("lease-2", "w1", 200.0, 3).collect()] == [r["id"] for r in batch]
    done = frame(spark, [(batch[0]["id"], batch[0]["source"])], "id STRING, target STRING")
    terms = frame(spark, [(0, "a", "x", "place", "w1"), (1, "a", "y", "place", "w1")], "seq BIGINT, source STRING, target STRING, category STRING, worker STRING")
    assert stored.submit("sub-1", done, "w1", "lease-1", 300.0, terms)
    with pytest.raises(catalog.Rejected):
        stored.submit("sub-2", done, "w1", "lease-1", 300.0)
    assert rows(stored.table("glossary").select("source", "target")) == ["Row(source='a', target='x')"]
    reports = frame(spark, [(0, batch[1]["id"], "unclear")], "seq BIGINT, id STRING, reason STRING")
    assert stored.quarantine("q-1", reports, "w1", 400.0)
    assert stored.release("rel-1", "w1")
    status = stored.status().first()
    assert (status["translated"], status["leased"], status["quarantined"], status["glossary_conflicts"]) == (1, 0, 1, 1)
    mine = stored.claim("lease-3", "w2", 500.0)
    assert mine.count() == status["pending_translation"]
    assert {r["expires"] for r in mine.collect()} == {2300.0}
    assert stored.claim("lease-4", "w3", 2300.0).count() == status["pending_translation"]  # the other lease has ended
    assert stored.table("items").where("worker = 'w2'").count() == 0
    some = frame(spark, [(1, "text 1", "excluded", None, None), (2, "text 3", None, None, "t")], "seq BIGINT, source STRING, usage STRING, reason STRING, target STRING")
    assert stored.import_rows("imp", some, 3000.0)
    assert stored.table("items").where("updated = 3000").count() <= 1
    with pytest.raises(catalog.Rejected):
        stored.claim("../x", "w3", 1.0)
