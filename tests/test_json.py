import json
import random

from pyspark.sql import functions as F

from glossaflow.sources import json_build, json_walk


def some(rng, depth):
    kind = rng.randint(0, 5 if depth else 3)
    if kind == 4:
        return {rng.choice(["a", "b", "a/b", "", 'q"\\', "é"]): some(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if kind == 5:
        return [some(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 7, -2, "text", "", 'a "b"\n\\', "日本"])


def frame(spark, values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "file INT, text STRING")


def parsed(df):
    return df.select("file", json_walk.parsed(F.col("text")).alias("value"))


def walk(value, path=""):
    parts = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if parts is None:
        yield path[1:], None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    else:
        for k, v in parts:
            yield from walk(v, f"{path}/{k}")


def values(n=80):
    rng = random.Random(5)
    return [some(rng, 4) for _ in range(n)]


def test_leaves_at_any_depth(spark):
    deep = "x"
    for i in range(20):
        deep = [None, deep] if i % 2 else {"k": deep}
    every = [*values(), {}, [], [None], [[[[[[[[None, None]]]]]]]], deep, {"a": {}, "b": [[]]}]
    found = {(r["file"], r["path"], r["text"]) for r in json_walk.leaves(parsed(frame(spark, every))).collect()}
    assert found == {(i, p, t) for i, v in enumerate(every) for p, t in walk(v)}


def test_documents_come_back_from_their_leaves(spark):
    every = [*values(), {}, [], None, [[], {}, [{}]]]
    leaves = json_walk.steps(parsed(frame(spark, every)))
    back = json_build.assembled(leaves)
    assert {r["file"]: json.loads(r["text"]) for r in back.collect()} == dict(enumerate(every))
    again = json_walk.steps(parsed(back))
    assert sorted(map(str, again.collect())) == sorted(map(str, leaves.collect()))
    assert json_build.assembled(leaves.limit(0)).count() == 0


def plain_merge(base, over):
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return over
    return {**base, **{k: plain_merge(base[k], v) if k in base else v for k, v in over.items()}}


def test_merge(spark):
    base = [*values(), {"a": {"b": 1}}, {"a": 1}, {"a": {}}, {"a": {}}, {"a": {"b": 1}}, {"a": [1, 2]}, {"a": {"x": 1}}, {}, {"a": 1}, {"a": {"l": 1, "n": 2}}]
    over = [*values()[::-1], {"a": 5}, {"a": {"b": 2}}, {"a": {}}, {"a": {"c": 1}}, {"a": {}}, {"a": [3]}, {"a": []}, {"a": 1}, {}, {"a": {"n": 3}}]
    found = json_build.merge_documents(frame(spark, base), frame(spark, over))
    assert {r["file"]: json.loads(r["text"]) for r in found.collect()} == {i: plain_merge(b, o) for i, (b, o) in enumerate(zip(base, over, strict=True))}
    one = json_build.merge_documents(frame(spark, [1, {"a": 2}]), frame(spark, [{}]).where("file < 0"))
    assert {r["file"]: json.loads(r["text"]) for r in one.collect()} == {0: 1, 1: {"a": 2}}
