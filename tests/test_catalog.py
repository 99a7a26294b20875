import pytest
from pyspark.sql import functions as F

from glossaflow.operators import catalog, leasing, quality

OCC = "seq BIGINT, source STRING, surface STRING, ref STRING, context STRING, hint STRING"
TERMS = "seq BIGINT, source STRING, target STRING, category STRING, worker STRING"


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        (0, "hello there", "ui", "r1", "c", "display"),
        (1, "logic", "script", "r2", "c", "protected"),
        (2, "unclear", "ui", "r3", "c", "unknown"),
        (3, "hello there", "map", "r4", "c", "protected"),
        (4, "hello there", "ui", "r1", "later", "unknown"),
        (5, "second one", "ui", "r5", "c", "display"),
        (6, None, "ui", "r6", "c", "display"),
    ]
    occ = spark.createDataFrame(rows, OCC)
    items = catalog.new_items(occ, spark.createDataFrame([], catalog.ITEM_COLUMNS)).cache()
    refs = catalog.merged_refs(occ, spark.createDataFrame([], catalog.REF_COLUMNS)).cache()
    none = spark.createDataFrame([], "id STRING, reason STRING, worker STRING, created DOUBLE")
    return occ, items, refs, none


def by_source(df, column):
    return {r["source"]: r[column] for r in df.collect()}


def test_first_occurrence_fixes_the_usage(world):
    occ, items, refs, _ = world
    assert by_source(items, "usage") == {"hello there": "display", "logic": "protected", "unclear": "pending", "second one": "display"}
    assert by_source(items, "released") == {"hello there": True, "logic": False, "unclear": False, "second one": True}
    assert catalog.new_items(occ, items).count() == 0
    assert refs.where("ref = 'r1'").select("context", "hint").collect() == [("later", "unknown")]


def test_decisions(spark, world):
    _, items, _, none = world
    ids = by_source(items, "id")
    good = spark.createDataFrame([(ids["unclear"], "dual", " both ")], "id STRING, usage STRING, reason STRING")
    after = catalog.apply_decisions(items, good, none)
    assert by_source(after, "usage")["unclear"] == "dual" and not by_source(after, "released")["unclear"] and by_source(after, "reason")["unclear"] == "both"
    assert by_source(catalog.apply_decisions(items, good, none, allow_dual=True), "released")["unclear"]
    held = spark.createDataFrame([(ids["unclear"], "x", "w", 0.0)], none.schema)
    assert not by_source(catalog.apply_decisions(items, good, held, allow_dual=True), "released")["unclear"]
    for bad in ((ids["unclear"], "dual", "  "), (ids["unclear"], "pending", "r"), ("nope", "display", "r"), (ids["unclear"], None, "r")):
        with pytest.raises(catalog.Rejected):
            catalog.apply_decisions(items, spark.createDataFrame([bad], good.schema), none)


def test_refs_batches_and_status(spark, world):
    _, items, refs, none = world
    assert {r["source"]: len(r["refs"]) for r in catalog.with_refs(items, refs, 1).collect()} == dict.fromkeys(by_source(items, "id"), 1)
    assert [r["source"] for r in catalog.pending_audit(items, refs).collect()] == ["unclear"]
    numbers = spark.range(0, 1000).withColumnRenamed("id", "seq")
    assert {(r["seq"], r["batch"]) for r in catalog.batches(numbers, 7).collect()} == {(n, n // 7 + 1) for n in range(1000)}
    row = catalog.status(items, spark.createDataFrame([], "source STRING"), none).first()
    assert (row["released"], row["translated"], row["pending_translation"], row["pending_audit"]) == (2, 0, 2, 1)


def test_leases(spark, world):
    _, items, refs, _ = world
    first, batch = leasing.claim(items, refs, "w1", "L1", 100.0, limit=1)
    assert [r["source"] for r in batch.collect()] == ["hello there"]
    again, batch = leasing.claim(first, refs, "w1", "L9", 200.0, limit=1)
    assert [(r["lease"], r["expires"]) for r in batch.collect()] == [("L1", 2000.0)]
    assert [r["source"] for r in leasing.claim(again, refs, "w2", "L2", 300.0)[1].collect()] == ["second one"]
    assert leasing.reclaim(again, 1999.0).where("worker IS NOT NULL").count() == 1 and leasing.reclaim(again, 2000.0).where("worker IS NOT NULL").count() == 0
    item = by_source(items, "id")["hello there"]
    good = spark.createDataFrame([(item, "bonjour")], "id STRING, target STRING")
    done = leasing.submit(again, good, "w1", "L1", 300.0)
    assert by_source(done, "target")["hello there"] == "bonjour" and catalog.mapping(done).count() == 1
    for now, lease, target in ((2000.0, "L1", "x"), (300.0, "L2", "x"), (300.0, "L1", " "), (300.0, "L1", "two\nlines")):
        with pytest.raises(catalog.Rejected):
            leasing.submit(again, spark.createDataFrame([(item, target)], good.schema), "w1", lease, now)
    assert leasing.release(again, "w1").where("worker IS NOT NULL").count() == 0
    assert leasing.remaining(done).first()[0] == 1
    with pytest.raises(catalog.Rejected):
        leasing.claim(items, refs, "bad worker!", "L", 0.0)


def test_glossary_and_quarantine(spark, world):
    _, items, _, none = world
    terms = spark.createDataFrame([(0, "a", "x", "place", "w"), (1, "a", "y", "place", "w"), (2, "a", "x", "place", "w"), (3, "b", "z", "person", "w")], TERMS)
    merged, conflicts = catalog.merge_terms(spark.createDataFrame([("b", "old", "person", "v")], "source STRING, target STRING, category STRING, worker STRING"), terms)
    assert {(r["source"], r["target"]) for r in merged.collect()} == {("a", "x"), ("b", "old")}
    assert {(r["source"], r["old"], r["new"]) for r in conflicts.collect()} == {("a", "x", "y"), ("b", "old", "z")}
    assert catalog.bad_terms(terms.withColumn("category", F.lit("verb"))).count() == 4
    reports = spark.createDataFrame([(0, by_source(items, "id")["second one"], "unclear"), (1, by_source(items, "id")["second one"], "later")], "seq BIGINT, id STRING, reason STRING")
    after, held = catalog.quarantined(items, none, reports, "w1", 5.0)
    assert not by_source(after, "released")["second one"] and [r["reason"] for r in held.collect()] == ["unclear"]


IMPORT = "seq BIGINT, source STRING, usage STRING, reason STRING, target STRING"


def test_import_holds_the_last_row(spark, world):
    _, items, _, none = world
    first, second, *_ = [r["source"] for r in items.orderBy("seq").collect()]
    rows = [(4, first, "display", "aaa last", "last"), (1, first, "excluded", "z first", "zzz first"), (2, first, "", None, " bad "), (3, second, "display", None, None), (5, second, None, "no decision", "x"), (6, "unknown", "display", "r", "t")]
    after, report = catalog.import_rows(items, spark.createDataFrame(rows, IMPORT), none, False, 77.0)
    got = {r["source"]: r for r in after.collect()}
    assert (got[first]["usage"], got[first]["reason"], got[first]["target"], got[first]["updated"]) == ("display", "aaa last", "last", 77.0)
    assert (got[second]["reason"], got[second]["target"]) == ("imported", "x")
    assert report.first().asDict() == {"usage_applied": 3, "applied": 3, "rejected": 1, "unknown": 1}
    with pytest.raises(catalog.Rejected):
        catalog.import_rows(items, spark.createDataFrame([(1, first, "display", "  ", None)], IMPORT), none, False, 77.0)
    same, empty = catalog.import_rows(items, spark.createDataFrame([], IMPORT), none, False, 77.0)
    assert same.count() == items.count() and set(empty.first()) == {0}


def test_residual_scan(spark):
    texts = spark.createDataFrame([(1, "設定"), (2, "ボス"), (3, "plain"), (4, "名：設定"), (5, " "), (6, "デバッグ x")], "seq BIGINT, text STRING")
    known = spark.createDataFrame([("設定",), ("x",)], "source STRING")
    allow = spark.createDataFrame([("デバッグ",)], "text STRING")
    got = {r["seq"]: r["hits"] for r in quality.residual_scan(texts, known, "ja", allow).collect()}
    assert got == {1: ["設定"], 2: [], 4: ["設定"]}


def test_manifest(spark):
    schema = "path STRING, size BIGINT, mtime_ns BIGINT, sha256 STRING"
    a = spark.createDataFrame([("same", 1, 1, "x"), ("gone", 1, 1, "x"), ("size", 1, 1, "x"), ("touched", 1, 1, "x"), ("edited", 1, 1, "x"), ("quiet", 1, 1, "x"), ("save/1", 1, 1, "x")], schema)
    b = spark.createDataFrame([("same", 1, 1, "x"), ("new", 1, 1, "x"), ("size", 2, 1, "x"), ("touched", 1, 2, "x"), ("edited", 1, 2, "y"), ("quiet", 1, 1, "y")], schema)
    got = {r["path"]: r["change"] for r in quality.manifest_diff(a, b, exclude=("save/*",)).collect()}
    assert got == {"gone": "missing", "new": "added", "size": "size", "edited": "content"}
    assert {r["path"] for r in quality.manifest_diff(a, b, deep=True, exclude=("save/*",)).collect()} == {*got, "quiet"}


def test_gate(spark, world):
    _, items, _, _ = world
    conflicts = spark.createDataFrame([], "source STRING")
    assert quality.gate(items, conflicts, None).first()["problems"] == ["pending", "untranslated", "no manifest"]
    fine = items.withColumn("usage", F.lit("display")).withColumn("released", F.lit(True)).withColumn("target", F.col("source"))
    assert quality.gate(fine, conflicts, spark.createDataFrame([], "path STRING, change STRING")).first()["problems"] == []
