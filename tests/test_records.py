import json

import pytest

from glossaflow.operators import catalog, listing, quality
from glossaflow.sources import records
from glossaflow.streaming import leases


def test_rows_of_json_files(spark, tmp_path):
    good = tmp_path / "rows.json"
    good.write_text("\ufeff" + json.dumps([{"source": "a", "target": "b", "more": 1}, {"source": "c", "usage": "display", "reason": "x"}]), encoding="utf-8")
    rows = records.read_rows(spark, str(good), "import")
    assert rows.columns == ["seq", "source", "usage", "reason", "target"]
    assert [tuple(r) for r in rows.orderBy("seq").collect()] == [(0, "a", None, None, "b"), (1, "c", "display", "x", None)]
    for text in ("{}", "no json", ""):
        (bad := tmp_path / "bad.json").write_text(text or " ", encoding="utf-8")
        with pytest.raises(catalog.Rejected):
            records.read_rows(spark, str(bad), "submit")


def test_audit_export(spark, tmp_path):
    items = spark.createDataFrame([(i, f"i{i}", f"s{i}", "pending" if i % 2 else "display") for i in range(1, 26)], "seq BIGINT, id STRING, source STRING, usage STRING")
    refs = spark.createDataFrame([(f"i{i}", "f", str(k), None, None) for i in range(1, 26) for k in range(8)], catalog.REF_COLUMNS)
    for _ in range(2):  # the second export takes the place of the first
        records.export_audit(items, refs, str(tmp_path / "out"), 5)
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted((r["batch"], r["id"], len(r["refs"])) for r in got.collect()) == sorted((n // 5 + 1, f"i{i}", 6) for n, i in enumerate(range(1, 26, 2)))


def test_records_and_warnings(spark):
    lines = [("a", '{"state": "running", "started": 1.5}'), ("b", "[1]"), ("c", "{broken"), ("d", None), ("e", '{"state": "x", "started": "late"}')]
    found, warned = listing.read_records(spark.createDataFrame(lines, "name STRING, value STRING"), "state STRING, started DOUBLE")
    assert [tuple(r) for r in found.collect()] == [("a", "running", 1.5)]
    assert {r["name"] for r in warned.collect()} == {"b", "c", "d", "e"}


@pytest.mark.parametrize("most", [200_000, 0])
def test_parts_in_texts(spark, monkeypatch, most):
    """By the automaton, and, when parts are too many for it, by anchors."""
    monkeypatch.setattr(quality, "MOST_PARTS", most)
    texts = ["the old hero went out", "勇者の剣と盾", "a", "", None, "xa hero", "old  hero", "hero"]
    parts = ["hero", "old hero", "the old hero", "剣", "勇者", "者の剣", "a", "", "not there", " hero "]
    df = spark.createDataFrame(list(enumerate(texts)), "seq BIGINT, text STRING")
    got = {tuple(r) for r in quality.containing(df, spark.createDataFrame([(p,) for p in parts], "part STRING")).collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in parts if t and p and p in t}


def test_export_json(spark, tmp_path):
    path = str(tmp_path / "out")
    for rows in ([(1, "a \u2028 b", None)], [(2, "日本\n\"q\"", 1.5), (3, None, None)]):  # the second export takes the place of the first
        records.export_json(spark.createDataFrame(rows, "id INT, text STRING, x DOUBLE"), path)
    assert sorted((r["id"], r["text"], r["x"]) for r in spark.read.json(path, schema="id INT, text STRING, x DOUBLE").collect()) == [(2, "日本\n\"q\"", 1.5), (3, None, None)]


def test_free_items_leave_no_state():
    class State:
        exists, value, removed = False, None, False

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

        def remove(self):
            self.exists, self.removed = False, True

    import pandas as pd

    state = State()
    event = lambda seq, action, target=None: pd.DataFrame([(seq, float(seq), "w", action, target)], columns=["seq", "at", "worker", "action", "target"])
    outcomes = [list(leases._advance(("i",), iter([event(n, a, t)]), state))[0]["outcome"][0] for n, (a, t) in enumerate([("claim", None), ("release", None), ("submit", "x"), ("claim", None), ("submit", "a\0"), ("submit", "ok")])]
    assert outcomes == ["accepted", "accepted", "not leased", "accepted", "nul", "accepted"] and state.removed and state.value[2] == "ok"
