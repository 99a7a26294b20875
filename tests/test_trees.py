import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaflow.operators import listing
from glossaflow.sources import trees

FILES = {"a.txt": b"one", ".hidden": b"h", "_under/x y.bin": bytes(range(256)) * 40, "deep/er/still/é.txt": "日本".encode(), "deep/save/1.sav": b"", "deep/z.log": b"log"}


@pytest.fixture
def root(tmp_path):
    for p, data in FILES.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_bytes(data)
    (tmp_path / "src" / "empty" / "inner").mkdir(parents=True)
    return str(tmp_path / "src")


def files(path):
    return {os.path.relpath(os.path.join(d, n), path): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(path) for n in names}


def folders(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, names, _ in os.walk(path) for n in names}


def test_listing_and_manifest(spark, root):
    found = {r["path"]: (r["kind"], r["size"]) for r in trees.tree(spark, root).collect()}
    assert found == {p: ("file", len(d)) for p, d in FILES.items()} | {p: ("folder", None) for p in folders(root)}
    rows = {r["path"]: r for r in trees.manifest(spark, f"file://{root}", ("*.log", "save/*")).collect()}
    assert {p: r["sha256"] for p, r in rows.items()} == {p: hashlib.sha256(d).hexdigest() for p, d in FILES.items() if p != "deep/z.log"}
    assert rows["a.txt"]["mtime_ns"] == os.stat(f"{root}/a.txt").st_mtime_ns
    assert trees.tree(spark, root + "/missing").count() == 0
    lines = [r["value"] for r in listing.checksums(trees.manifest(spark, root)).collect()]
    assert lines == [f"{hashlib.sha256(FILES[p]).hexdigest()}  {p}" for p in sorted(FILES)]


def test_copy_and_refusal(spark, root, tmp_path):
    target = str(tmp_path / "out")
    trees.copy_tree(spark, root, target, ("deep/save/*", "*.log"))
    assert files(target) == {p: d for p, d in FILES.items() if p not in ("deep/save/1.sav", "deep/z.log")}
    assert folders(target) == folders(root)
    with pytest.raises(trees.NotEmpty):
        trees.copy_tree(spark, root, target)


def test_a_failed_copy_leaves_nothing(spark, root, tmp_path):
    rows = trees.tree(spark, root).where("kind = 'file'").select("path", F.when(F.col("path") == "a.txt", F.lit(root + "/gone")).otherwise(F.concat(F.lit(root + "/"), "path")).alias("source"))
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception, match="gone"):
        rows.write.format("tree").mode("append").save(str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_restore(spark, root, tmp_path):
    copy = str(tmp_path / "copy")
    trees.copy_tree(spark, root, copy)
    before = trees.manifest(spark, copy)
    with open(f"{root}/a.txt", "wb") as f:
        f.write(b"two")
    os.remove(f"{root}/deep/z.log")
    trees.write_tree(spark.createDataFrame([("new/file", bytearray(b"n")), ("deep/extra", None)], "path STRING, content BINARY"), root)
    assert files(root)["deep/extra"] == b""
    done = {(r["path"], r["action"]) for r in trees.restore(spark, root, before, copy).collect()}
    assert done == {("a.txt", "copied"), ("deep/z.log", "copied"), ("new/file", "deleted"), ("deep/extra", "deleted")}
    assert files(root) == FILES
    assert trees.restore(spark, root, before, copy).count() == 0


def test_checksums_of_ranges(spark, root):
    for size in (1, 7, 5000, 1 << 20):
        found = {r["path"]: r["adler32"] for r in trees.checksums(spark, root, range_bytes=size).collect()}
        assert found == {p: zlib.adler32(d) for p, d in FILES.items()}


def test_sums_of_blocks_equal_the_library(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for k in range(20):
        data = rng.randbytes(rng.randint(0, 3000))
        expected[str(k)] = zlib.adler32(data)
        rows += [(str(k), len(data), at, *trees.adler_sums(np.frombuffer(data[at : at + 100], np.uint8))) for at in range(0, max(len(data), 1), 100)]
    rng.shuffle(rows)
    sums = spark.createDataFrame(rows, "path STRING, size BIGINT, at BIGINT, one BIGINT, two BIGINT")
    assert {r["path"]: r["adler32"] for r in trees.merged_adler(sums, 100).collect()} == expected
