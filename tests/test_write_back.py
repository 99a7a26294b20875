import json

from pyspark.sql import functions as F

from glossaflow.sources import scripts, write_back


def test_fields_are_translated_in_place(spark):
    actors = [None, {"id": 1, "name": "ハル", "profile": "勇者\nです", "note": "ハル"}]
    system = {"gameTitle": "題名", "terms": {"messages": {"greeting": "こんにちは"}}}
    untouched = '{ "displayName" : "" }'
    rows = [("Actors.json", "﻿" + json.dumps(actors)), ("System.json", json.dumps(system)), ("Map001.json", untouched)]
    docs = spark.createDataFrame(rows, "file STRING, text STRING")
    pairs = spark.createDataFrame([("ハル", "Haru"), ("題名", "題名"), ("こんにちは", "Hello")], "source STRING, target STRING")
    out = {r["file"]: r for r in write_back.translate_fields(docs, pairs).collect()}
    assert json.loads(out["Actors.json"]["text"]) == [None, {**actors[1], "name": "Haru"}] and out["Actors.json"]["n_edits"] == 1
    assert out["System.json"]["text"] == '{"gameTitle":"題名","terms":{"messages":{"greeting":"Hello"}}}'
    assert (out["Map001.json"]["text"], out["Map001.json"]["n_edits"]) == (untouched, 0)


def test_keys_with_the_separator(spark):
    docs = spark.createDataFrame([("f", '{"a/b": {"c": [1, "x"]}, "a": {"d": "y"}}')], "file STRING, text STRING")
    edits = spark.createDataFrame([("f", "a/b/c/1", "X"), ("f", "a/d", "Y")], "file STRING, path STRING, target STRING")
    assert [tuple(r) for r in write_back.write_back(docs, edits).collect()] == [("f", '{"a/b":{"c":[1,"X"]},"a":{"d":"Y"}}', 2)]


def test_overrides(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path STRING, content BINARY")
    over = spark.createDataFrame([("b", b"3"), ("c", b"4")], "path STRING, content BINARY")
    assert {(r["path"], bytes(r["content"]), r["replaced"]) for r in write_back.replace_files(files, over).collect()} == {("a", b"1", False), ("b", b"3", True)}
    assert [r[0] for r in write_back.unknown_overrides(files, over).collect()] == ["c"]


def test_plugin_parameters(spark):
    text = r'{"name":"見出し","a":"{\"x\":\"なか\"}","b":"あい","c":"plain"}'
    texts = spark.createDataFrame([(1, text), (2, None)], "seq BIGINT, text STRING")
    got = scripts.plugin_parameters(texts).orderBy("start").collect()
    assert [(r["source"], r["hint"]) for r in got] == [("見出し", "protected"), ("あい", "protected")]
    assert [text[r["start"]] for r in got] == ['"', '"']


def test_scene_and_script_strings(spark):
    scene = '[node name="A"]\ntext = "はい\nいいえ"\n name = "ない"\ntooltip_text="\\"助言\\""\n'
    got = scripts.scene_texts(spark.createDataFrame([(1, scene)], "seq BIGINT, text STRING")).collect()
    assert {(r["property"], r["source"]) for r in got} == {("text", "はい\nいいえ"), ("tooltip_text", '"助言"')}
    code = "var a = 'x'\n  say(\"こん\\\"にちは\", '二つ')\r\n"
    got = scripts.script_strings(spark.createDataFrame([(1, code)], "seq BIGINT, text STRING")).orderBy(F.desc("source")).collect()
    assert {(r["line"], r["source"]) for r in got} == {(2, 'こん"にちは'), (2, "二つ")} and got[0]["context"].startswith("say(")
