import json
import random

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import sql, text
from glossaflow.operators import catalog
from glossaflow.sources import json_walk, scripts


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    parts = ['say("Hello there", \'two words\')', 'text = "Go \\"on\\""', "title=\"a b\\nc\"", "name = \"not shown\"", "plain words", "ident_1", "res://x", "日本", " [b]tag[/b] ", "", "\r", "it's \\\\ so"]
    rows = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(150)] + [(150, None), (151, "")]
    df = spark.createDataFrame(rows, "seq BIGINT, text STRING")
    sql.register(spark)
    df.createOrReplaceTempView("texts")
    return df


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_scalar_functions(spark, texts):
    lines = texts.select(F.explode(F.split("text", "\n")).alias("t")).distinct()
    lines.createOrReplaceTempView("lines")
    for lang in ("en", "ja", "zh", "ko"):
        found = spark.sql(f"SELECT t, item_id(t), visible_text(t), has_source_text(t, '{lang}'), is_candidate(t, '{lang}') FROM lines")
        t = F.col("t")
        assert rows(found) == rows(lines.select("t", catalog.item_id(t), text.strip_tags(t), text.has_source_text(t, lang), text.is_candidate(t, lang)))
    with pytest.raises(Exception, match="unsupported"):
        spark.sql("SELECT has_source_text(t, 'xx') FROM lines").collect()


def test_table_functions_equal_the_calls_on_frames(spark, texts):
    found = spark.sql("SELECT seq, s.* FROM texts, LATERAL script_strings(text, 'en') s")
    assert rows(found) == rows(scripts.script_strings(texts, "en").select("seq", "line", "source")) and found.count() > 50
    found = spark.sql("SELECT seq, s.*, 'display' FROM texts, LATERAL scene_texts(text, 'en') s")
    assert rows(found) == rows(scripts.scene_texts(texts, "en")) and found.count() > 50
    found = spark.sql("SELECT seq, l.* FROM texts, LATERAL text_lines(text) l")
    assert rows(found) == rows(texts.select("seq", F.posexplode(F.split("text", "\n", -1)).alias("p", "l")).where("l <> ''").select("seq", F.col("p") + 1, "l"))


def test_json_leaves_in_sql(spark, texts):
    docs = [{"a": [1, {"b": "x"}], "c": None}, [], {}, "s", [[], {"k": [None, True]}], {"deep": [[[[["end"]]]]]}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "broken"), (10, None)], "file INT, doc STRING")
    df.createOrReplaceTempView("docs")
    found = spark.sql("SELECT file, l.* FROM docs, LATERAL json_leaves(doc) l")
    assert rows(found) == rows(json_walk.leaves(df.select("file", json_walk.parsed(F.col("doc")).alias("value"))))


def test_table_functions_of_texts_need_no_join(spark, texts):
    for call in ("script_strings(text, 'en')", "scene_texts(text, 'en')", "text_lines(text)"):
        plan = spark.sql(f"SELECT seq, s.* FROM texts, LATERAL {call} s")._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan
