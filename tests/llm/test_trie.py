import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glossaflow.llm import prefix_trie

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows, rebuild):
    """Nodes by dictionaries of prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", (text or "")[: prefix_trie.TIE], text or ""))
    convs = {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in convs.items()}
    paths = convs
    if rebuild:
        paths = {}
        for c, turns in convs.items():
            h = zlib.crc32(str(c).encode()) % 6
            paths[c] = convs.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, ids in members.items():
        leaves, saved, stack = 0, 0, [node]
        while stack:
            x = stack.pop()
            below = children.get(x, [])
            leaves += not below
            saved += (len(members[x]) - 1) * (len(x[-1][1]) if x else 0)
            stack += below
        ends = ",".join(map(str, sorted(c for c in ids if len(paths[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **args):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **args).select(*COLUMNS).collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "日本", "", None, "long text 😀" * 9])) for c in (*range(-3, 25), 100, 101, 199, 205, 300, 12345) for t in range(rng.randint(1, 7))]
    rows += [(100, t, "user", "same") for t in range(9)] + [(c, None, "user", "first of all") for c in (3, 3, 101)]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "assistant", "x" * 40 + "b"), (7, 1, None, None), (None, 1, "user", "nobody's"), (-250, 0, None, None), (-200, 0, "user", "q")]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_awkward_conversations(spark, rebuild):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    for name in ("id", "place", "depth", "part", "n", "h", "mark"):
        df = df.withColumn(name, F.lit("extra"))
    assert result(df, rebuild=rebuild) == plain(odd_rows(), rebuild)


def test_one_conversation_over_many_ranges_and_copies(spark):
    rows = [(500, t, "user", f"turn {t % 50}") for t in range(700)] + [(c, t, "user", f"turn {t}") for c in range(1, 400) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert result(df) == plain(rows, False)
    assert result(df, rebuild=True) == plain(rows, True)


def test_ids_of_one_node_go_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    ends = spark.createDataFrame([(1, 2, c) for c in range(-5, 300)] + [(1, 3, 4)], "d1 BIGINT, d2 BIGINT, conv_id BIGINT")
    found = {(r["d1"], r["d2"]): r["ends_sha256"] for r in prefix_trie.end_hashes(ends).collect()}
    assert found == {(1, 2): hashlib.sha256(",".join(map(str, range(-5, 300))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"4").hexdigest()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(empty) == [] and result(empty, rebuild=True) == []
    lone = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert result(lone, rebuild=True) == []
