import random
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from glossaflow.functions import packed, text
from glossaflow.operators import listing
from glossaflow.sources import length_prefixed


def test_integers(spark):
    rng = random.Random(1)
    rows = [(i, bytearray(rng.randbytes(rng.randint(0, 12))), rng.randint(-2, 12)) for i in range(200)] + [(200, None, 0)]
    df = spark.createDataFrame(rows, "id INT, data BINARY, at INT")
    found = df.select("id", *[f(F.col("data"), F.col("at"), w).alias(f"{f.__name__}{w}") for f in (packed.unsigned, packed.signed) for w in (1, 2, 4)], packed.integers(F.col("data"), F.col("at"), F.lit(3), 2).alias("many"))
    for r in found.collect():
        _, data, at = rows[r["id"]]
        for w in (1, 2, 4):
            raw = bytes(data[at : at + w]) if data is not None and at >= 0 else b""
            assert r[f"unsigned{w}"] == (int.from_bytes(raw, "little") if len(raw) == w else None)
            assert r[f"signed{w}"] == (int.from_bytes(raw, "little", signed=True) if len(raw) == w else None)
        places = [at + 2 * i for i in range(3)]
        assert data is None or r["many"] == [struct.unpack_from("<h", data, p)[0] for p in places if p >= 0 and p + 2 <= len(data)]
    back = spark.range(-3, 70_000, 997).select("id", packed.signed(packed.packed(F.col("id")), 0).alias("again"))
    assert back.where("id <> again").count() == 0


def test_commands_hints_and_marks(spark):
    rows = [(101, [], 0), (102, [1], 3), (150, [0x20], 0), (150, [0x30], 0), (150, [0x20], 1), (150, [], 0), (122, [], 0), (122, [], 1), (112, [], 0), (250, [], 0), (103, [], 0), (106, [], 0), (999, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq INT, command INT, arguments ARRAY<INT>, n INT")
    kinds = df.withColumn("kind", packed.command_kind(F.col("command"), F.col("arguments"), F.col("n")))
    assert [r["kind"] for r in kinds.orderBy("seq").collect()] == ["message", "choice", "picture-text", "other", "other", "other", "set-string", "other", "logic", "logic", None, None, "other"]
    assert [r["seq"] for r in packed.hinted(kinds).collect()] == [8, 9, 3, 4, 5, 6, 7, 12, 0, 1, 2]
    fields = spark.createDataFrame([([0, 5], 0), ([0, 5], 1), ([0, 5], 2), ([], 0)], "types ARRAY<INT>, field INT")
    assert [tuple(r) for r in fields.select(packed.at_or(F.col("types"), F.col("field")), packed.field_kind(F.col("types"), F.col("field"))).collect()] == [(0, "db"), (5, None), (-1, None), (-1, None)]
    files = spark.createDataFrame([("map", bytearray(b"x" * 16 + b"U")), ("game", bytearray(b"x" * 9 + b"U")), ("db", bytearray(b"x" * 6 + b"U")), ("map", bytearray(b"xxxxxxU")), ("db", None)], "kind STRING, data BINARY")
    assert [r[0] for r in files.select(packed.marked_utf8(F.col("data"), F.col("kind"))).collect()] == [True, True, True, False, False]
    sizes = spark.range(0, 40).select("id", packed.padding(F.col("id"), 4).alias("p"), packed.aligned(F.col("id"), 16).alias("a")).collect()
    assert all(r["p"] == -r["id"] % 4 and r["a"] == (r["id"] + 15) // 16 * 16 for r in sizes)


def test_utf8_of_all_ranges_equals_decoding():
    import numpy as np

    rng = random.Random(3)
    parts = ["a", "é", "日", "😀", "\x00", "\n"]
    for _ in range(300):
        data = b"".join(rng.choice([rng.choice(parts).encode(), rng.randbytes(rng.randint(0, 2)), b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80"]) for _ in range(8))
        wrong, inside = length_prefixed.utf8_marks(np.frombuffer(data, np.uint8))
        sums, split = [0, *np.cumsum(wrong)], [*inside, False]
        for i in range(len(data) + 1):
            for j in range(i, len(data) + 1):
                try:
                    data[i:j].decode()
                    valid = True
                except UnicodeDecodeError:
                    valid = False
                assert valid == (i == j or (sums[i] == sums[j] and not split[i] and not split[j])), (data, i, j)


def plain(data, asset, fine):
    found, at, step = [], 0, 4 if asset else 1
    while at + 4 < len(data) + asset:
        n = int.from_bytes(data[at : at + 4], "little")
        raw = data[at + 4 : at + 4 + n]
        try:
            shown = raw.decode() if 2 <= n <= (8192 if asset else 4096) and len(raw) == n else ""
        except UnicodeDecodeError:
            shown = ""
        if not asset:
            shown = shown.rstrip("\0")
            shown = shown if shown.isprintable() or "\n" in shown else ""
        if shown and fine(shown):
            found.append((at, shown))
            at += 4 + (-(-n // step) * step)
        else:
            at += step
    return found


def test_probe_equals_a_walk_over_the_bytes(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, bytearray()), (2, bytearray(b"\x02\x00\x00\x00ab")), (3, bytearray(b"\x02\x00\x00"))]
    pieces = ["two words", "ab", "là été", "Go\nup", "so so\0\0", "日本 go to", "", "a b " * 99, "file.png"]
    for i in range(4, 60):
        data = bytearray()
        for _ in range(rng.randint(1, 12)):
            word = rng.choice(pieces).encode()
            data += rng.choice([*[struct.pack("<I", len(word)) + word] * 4, word, rng.randbytes(3), struct.pack("<I", rng.randint(0, 9)), b"\0"])
            data += b"\0" * rng.choice([0, -len(data) % 4])
        rows.append((i, data))
    df = spark.createDataFrame(rows, "id INT, content BINARY").repartition(3)
    fits = {}
    for asset in (False, True):
        shown = sorted({p for _, d in rows for p in _all(d or b"")})
        fits = {r["s"] for r in spark.createDataFrame([(s,) for s in shown], "s STRING").where(text.is_candidate(F.col("s"), "en")).collect()}
        expected = sorted((i, at, s) for i, d in rows for at, s in plain(bytes(d or b""), asset, fits.__contains__))
        assert sorted(tuple(r) for r in length_prefixed.probe(df, "en", asset).collect()) == expected
        assert len(expected) > 40


def _all(data):
    for at in range(len(data)):
        n = int.from_bytes(data[at : at + 4], "little")
        try:
            shown = bytes(data[at + 4 : at + 4 + n]).decode() if n <= 8192 else ""
        except UnicodeDecodeError:
            continue
        yield shown
        yield shown.rstrip("\0")


def test_scripts_of_all_encodings_from_files(spark, tmp_path):
    shown = "日本 text"
    bodies = {"utf8": shown.encode(), "mark": b"\xef\xbb\xbf" + shown.encode(), "little": b"\xff\xfe" + shown.encode("utf-16-le"), "big": b"\xfe\xff" + shown.encode("utf-16-be"), "legacy": shown.encode("cp932"), "none": b"\x81", "plain": b"abc"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.ks").write_bytes(body)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", r"(\w+)\.ks$", 1).alias("name"), "content")
    rows = {r["name"]: r for r in files.select("name", text.decode_script(F.col("content")).alias("text"), text.needs_code_page(F.col("content")).alias("needs")).collect()}
    assert {n: r["text"] for n, r in rows.items()} == {n: shown for n in bodies} | {"none": None, "plain": "abc"}
    assert {n for n, r in rows.items() if r["needs"]} == {"legacy", "none"}
    assert files.agg(F.bool_or(text.needs_code_page(F.col("content")))).first()[0]
    assert not files.where("name LIKE '%8'").agg(F.bool_or(text.needs_code_page(F.col("content")))).first()[0]


def test_recognised_lines_from_a_file(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('﻿{"file": "a", "lines": ["日 本 語 text", "x"]}\n{"file": "b", "error": "dark"}\n\n{"file": "c", "lines": []}\nno json\n{"file": "d"}\n', encoding="utf-8")
    rows = listing.read_recognised(spark.read.text(str(tmp_path / "r.jsonl")))
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, [("a", 0, "日本語 text", None), ("a", 1, "x", None), ("b", None, None, "dark"), (None, None, None, "unreadable"), ("d", None, None, "unreadable")]))
    assert tuple(listing.recognition_report(rows, rows.limit(0)).first()) == (3, 1, 0, False)
    assert listing.recognition_report(rows.where("file = 'b'"), rows.limit(0)).first()["says_nothing"]


def test_percents_and_times(spark):
    import time

    pairs = [(n, d) for d in (1, 3, 8, 200) for n in range(d + 1)]
    rows = spark.createDataFrame(pairs + [(1, 0), (None, 2)], "n INT, d INT").select("n", "d", text.percent(F.col("n"), F.col("d")).alias("p")).collect()
    assert all(r["p"] == (f"{r['n'] / r['d']:.0%}" if r["d"] and r["n"] is not None else None) for r in rows)
    found = spark.createDataFrame([(x,) for x in (0.0, 1.999999, 1.7e9 + 0.5, 4102444799.0)], "s DOUBLE").select("s", text.stamp(F.col("s")).alias("t"), text.iso_date(F.col("s")).alias("d")).collect()
    assert all((r["t"], r["d"]) == tuple(time.strftime(f, time.gmtime(r["s"])) for f in ("%Y%m%d-%H%M%S", "%Y-%m-%d")) for r in found)


def test_overlapping_texts_go_on_in_pieces(spark):
    data = (b"\x00\x0c\x00\x00" * 8_000)[:-1]  # a length of 3,072 at each fourth byte
    batch = pa.RecordBatch.from_pydict({"id": [7], "content": [data + b"x"]})
    found = list(length_prefixed._pieces(batch, length_prefixed.MOST_ASSET, 4, False))
    assert len(found) > 20 and max(b.nbytes for b in found) < 2 * length_prefixed.PIECE_BYTES
    places = [x for b in found for x in b.column(1).to_pylist()]
    assert places == list(range(0, 4 * (8_000 - 768), 4))


def test_packed_events_of_large_keys_and_halves_equal_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = "(0, 1, 0.125), (7, 40000, 1.0), (6, NULL, 0.32), (10000000001, 3000000000, NULL), (30000000005, 300000000000000, 99999999999.0)"
    events = f"SELECT a::BIGINT AS event_id, b::BIGINT AS user_id, c::DOUBLE AS value FROM (VALUES {rows}) t(a, b, c)"
    duckdb.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet'")
    told = duckdb.connect()
    told.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = told.execute(entry.oracle_sql()["packed_events"]).fetchall()
    found = [tuple(r) for r in entry.queries()["packed_events"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)
