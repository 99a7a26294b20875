import json

import pytest

from glossaflow.operators.catalog import Rejected
from glossaflow.sources import engines


def test_engines_are_found_and_read(spark):
    rows = [
        ("a", "www/data/System.json", json.dumps({"gameTitle": "題名", "elements": ["炎"]})), ("a", "www/js/rpg_core.js", "炎"), ("a", "www/js/plugins/x.js", "name = '題名'"),
        ("b", "data/scenario/first.ks", "#勇者\n本文"), ("c", "startup.tjs", "a = '設定'"), ("c", "x/main.ks", "本文[r]"), ("d", "readme.txt", ""),
    ]
    files = spark.createDataFrame(rows, "root STRING, path STRING, text STRING")
    assert {r["root"]: (r["engine"], r["score"]) for r in engines.detected(files).collect()} == {"a": ("json", 90), "b": ("tagged", 85), "c": ("scenario", 80)}
    found = lambda name, root: {(r["source"], r["hint"]) for r in engines.engine(name).occurrences(files.where(f"root = '{root}'"), "ja").collect()}
    assert found("json", "a") == {("題名", "unknown"), ("炎", "display")}
    assert found("tagged", "b") == {("勇者", "unknown"), ("本文", "display")}
    assert found("scenario", "c") == {("設定", "protected"), ("本文[r]", "display")}


def test_names_are_taken_once():
    with pytest.raises(Rejected):
        engines.register(engines.engine("json"))
    with pytest.raises(Rejected):
        engines.engine("none")
