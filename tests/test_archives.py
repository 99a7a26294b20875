import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from glossaflow.sources import archives


def xp3(files, elsewhere=False, packed=True, cuts=1, wrong=()):
    """The bytes of an XP3 archive of {path: bytes}, each in `cuts` parts."""
    begin, body, index = archives.XP3_BEGIN, b"", b""
    base = len(begin) + 8
    block = lambda name, data: name + struct.pack("<Q", len(data)) + data
    for path, data in files.items():
        parts, step = b"", max(1, -(-len(data) // cuts))
        for i in range(0, max(len(data), 1), step):
            raw = data[i : i + step]
            held = zlib.compress(raw) if i % 2 == 0 else raw
            parts += struct.pack("<IQQQ", int(i % 2 == 0), base + len(body), len(raw), len(held))
            body += held
        name = path.encode("utf-16-le")
        info = struct.pack("<IQQH", 0, len(data), 0, len(name) // 2) + name
        index += block(b"File", block(b"time", b"x" * 8) + block(b"info", info) + block(b"segm", parts) + block(b"adlr", struct.pack("<I", zlib.adler32(data) ^ (path in wrong))))
    index = block(b"skip", b"abc") + index
    held = zlib.compress(index)
    tail = struct.pack("<BQQ", 1, len(held), len(index)) + held if packed else struct.pack("<BQ", 0, len(index)) + index
    at = base + len(body)
    if elsewhere:
        tail = struct.pack("<BQQ", 0x80, 0, at + 17) + tail
    return begin + struct.pack("<Q", at) + body + tail


FILES = {f"data/scenario/s{i}.ks": (f"text {i} 日本 " * (i * 40)).encode() for i in range(12)} | {"data/a.png": bytes(range(256)) * 9, "readme.txt": b"", "ü/x.ks": b"z"}


@pytest.mark.parametrize(("elsewhere", "packed", "cuts"), [(False, True, 1), (True, True, 3), (False, False, 2)])
def test_xp3_reads_equal(spark, tmp_path, elsewhere, packed, cuts):
    (tmp_path / "a.xp3").write_bytes(xp3(FILES, elsewhere, packed, cuts))
    listing = archives.archive_entries(spark, str(tmp_path / "a.xp3"))
    assert {r["path"]: bytes(r["content"]) for r in archives.contents(listing, share_bytes=5000).collect()} == FILES
    assert listing.selectExpr("count(DISTINCT floor(place / 5000))").first()[0] > 3


def test_zip_and_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.nw", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("empty")
        for p, data in FILES.items():
            z.writestr(p, data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.xp3").write_bytes(xp3({"only": b"here"}))
    (tmp_path / "notes.txt").write_text("no archive")
    found = {r["path"]: bytes(r["content"]) for r in archives.contents(archives.archive_entries(spark, f"file://{tmp_path}")).collect()}
    assert found == FILES | {"only": b"here"}
    assert archives.scenario_files(archives.archive_entries(spark, str(tmp_path))).count() == 12
    assert archives.archive_entries(spark, str(tmp_path / "missing")).count() == 0


def test_a_filter_opens_only_its_entries(spark, tmp_path):
    data = bytearray(xp3(FILES))
    index = struct.unpack_from("<Q", data, len(archives.XP3_BEGIN))[0]
    wanted = [e for e in (lambda p: (p.write_bytes(bytes(data)), archives.entries(str(p)))[1])(tmp_path / "a.xp3") if e.path == "data/scenario/s3.ks"]
    for i in range(len(archives.XP3_BEGIN) + 8, index):  # all but the wanted entry is spoilt
        if not any(p.start <= i < p.start + p.packed for e in wanted for p in e.parts):
            data[i] ^= 255
    (tmp_path / "a.xp3").write_bytes(bytes(data))
    df = archives.archive_entries(spark, str(tmp_path / "a.xp3"))
    for test in (F.col("path") == "data/scenario/s3.ks", F.col("path").endswith("/s3.ks"), F.col("path").startswith("data/scenario/s3") & (F.col("size") > 1)):
        assert [bytes(r["content"]) for r in archives.contents(df.where(test)).collect()] == [FILES["data/scenario/s3.ks"]]
    assert archives.contents(df.where("path = 'none'")).count() == 0
    with pytest.raises(Exception, match="Broken|checksum|zlib|decompress"):
        archives.contents(df).collect()


def test_broken_entries(spark, tmp_path):
    (tmp_path / "a.xp3").write_bytes(xp3(FILES, wrong=("data/a.png",)))
    df = archives.contents(archives.archive_entries(spark, str(tmp_path / "a.xp3")), permissive=True)
    assert [(r["path"], r["content"]) for r in df.where("problem IS NOT NULL").collect()] == [("data/a.png", None)]
    with pytest.raises(Exception, match="checksum"):
        archives.contents(archives.archive_entries(spark, str(tmp_path / "a.xp3"))).collect()


def test_what_is_written_reads_equal_and_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = [(p, bytearray(c)) for p, c in FILES.items()] + [("null", None)]
    files = spark.createDataFrame(rows, "path STRING, content BINARY").repartition(3)
    archives.write_archives(files, str(tmp_path / "out"))
    found = {r["path"]: bytes(r["content"]) for r in archives.contents(archives.archive_entries(spark, str(tmp_path / "out"))).collect()}
    assert found == FILES | {"null": b""}
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="lost"):
        archives.write_archives(files.withColumn("path", F.when(F.col("path") == "null", F.raise_error(F.lit("lost"))).otherwise(F.col("path"))), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == names


def test_a_directory_is_read_once_and_entries_of_one_name_differ(spark, tmp_path, monkeypatch):
    with pytest.warns(UserWarning, match="Duplicate"), zipfile.ZipFile(tmp_path / "p.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(300):
            z.writestr("twice" if i < 2 else f"p{i}", f"text {i}")
    listing = archives.archive_entries(spark, str(tmp_path / "p.zip"))
    assert {bytes(r["content"]) for r in archives.contents(listing.where("path = 'twice'")).collect()} == {b"text 0", b"text 1"}
    read, once = [], zipfile.ZipFile._RealGetContents
    monkeypatch.setattr(zipfile.ZipFile, "_RealGetContents", lambda z: (read.append(1), once(z))[1])
    found = archives.entries(str(tmp_path / "p.zip"))
    opened = archives._Opened(str(tmp_path / "p.zip"))
    assert [opened.content(e) for e in found] == [f"text {i}".encode() for i in range(300)]
    assert len(read) == 2  # the listing, and all contents together
    opened.close()
