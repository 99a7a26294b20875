"""Archives as Spark data: XP3 and ZIP files, first their directories, then the entries that are wanted.

Format `archive` is a data source that gives one row for each entry of the archives at a path, without reading what they hold; each archive's
directory is read by a task. Any filter may follow. contents() then deals the entries out by archive and place, so many bytes to a share, and
reads only their ranges: a large archive is read by many tasks. (Filters are not pushed into the source itself: Spark keeps what was pushed
into a Python source with the loaded table, so a second query on it would see the entries of the first.)

Written to, the format makes ZIP files, one for each partition that has rows.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .folders import files_below, opened

PARTS = "ARRAY<STRUCT<start: BIGINT, packed: BIGINT, deflated: BOOLEAN>>"
LISTING = f"archive STRING, path STRING, size BIGINT, place BIGINT, parts {PARTS}, adler BIGINT"
CONTENTS = "archive STRING, path STRING, size BIGINT, content BINARY, problem STRING"
SHARE_BYTES = 64 << 20
#: What a task gives on at once.
BATCH_BYTES, BATCH_ENTRIES = 4 << 20, 1_000
# How an XP3 file begins, the mark of a directory that stands elsewhere, and the bits of packed parts.
XP3_BEGIN = b"XP3\r\n \n\x1a\x8bg\x01"
XP3_ELSEWHERE, XP3_PACKED_DIRECTORY, XP3_PACKED_PART = 0x80, 1, 7


class Broken(ValueError):
    """An archive or entry that cannot be read, perhaps because it is encrypted."""


@dataclass(frozen=True)
class Part:
    """A range of an archive that holds a piece of an entry."""

    start: int
    packed: int
    deflated: bool


@dataclass(frozen=True)
class Entry:
    archive: str
    path: str
    size: int
    parts: tuple[Part, ...]
    adler: int | None = None


class _Fields:
    """A block of bytes, read from its front."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        end = self.at + struct.calcsize(form)
        if end > len(self.data):
            raise Broken("a directory that ends early")
        values = struct.unpack_from(form, self.data, self.at)
        self.at = end
        return values

    def blocks(self) -> Iterator[tuple[bytes, _Fields]]:
        while self.at + 12 <= len(self.data):
            name, size = self.take("<4sQ")
            yield name, _Fields(self.data[self.at : self.at + size])
            self.at += size


def _xp3_directory(f) -> bytes:
    (start,) = struct.unpack("<Q", _exactly(f, len(XP3_BEGIN), 8))
    kind = _exactly(f, start, 1)[0]
    if kind == XP3_ELSEWHERE:
        (start,) = struct.unpack("<Q", _exactly(f, start + 9, 8))
        kind = _exactly(f, start, 1)[0]
    if kind & XP3_PACKED_DIRECTORY:
        (packed,) = struct.unpack("<Q", _exactly(f, start + 1, 8))
        return zlib.decompress(_exactly(f, start + 17, packed))
    (size,) = struct.unpack("<Q", _exactly(f, start + 1, 8))
    return _exactly(f, start + 9, size)


def _exactly(f, start: int, size: int) -> bytes:
    f.seek(start)
    data = f.read(size)
    if len(data) != size:
        raise Broken("an archive that ends early")
    return data


def _xp3_entries(archive: str, f) -> Iterator[Entry]:
    try:
        directory = _xp3_directory(f)
    except zlib.error as e:
        raise Broken(f"{archive}: {e}") from e
    for kind, body in _Fields(directory).blocks():
        if kind != b"File":
            continue
        path, size, parts, adler = None, 0, None, None
        for name, fields in body.blocks():
            if name == b"info":
                _, size, _, letters = fields.take("<IQQH")
                path = fields.data[fields.at : fields.at + 2 * letters].decode("utf-16-le")
            elif name == b"segm":
                parts = []
                while fields.at + 28 <= len(fields.data):
                    flags, start, _, packed = fields.take("<IQQQ")
                    parts.append(Part(start, packed, bool(flags & XP3_PACKED_PART)))
            elif name == b"adlr":
                (adler,) = fields.take("<I")
        if path is not None and parts is not None:
            yield Entry(archive, path, size, tuple(parts), adler)


def _zip_entries(archive: str, f) -> Iterator[Entry]:
    """Entries as ranges from their local heads on; a head is read with its entry."""
    with zipfile.ZipFile(f) as z:
        for i in z.infolist():
            if not i.is_dir():
                yield Entry(archive, i.filename, i.file_size, (Part(i.header_offset, i.compress_size, i.compress_type == zipfile.ZIP_DEFLATED),))


def entries(archive: str) -> list[Entry]:
    """The directory of an archive, of whichever kind its first bytes tell; [] of any other file."""
    system, at = opened(archive)
    with system.open_input_file(at) as f:
        begin = f.read(len(XP3_BEGIN))
        if begin == XP3_BEGIN:
            return list(_xp3_entries(archive, f))
        return list(_zip_entries(archive, f)) if begin[:4] in (b"PK\x03\x04", b"PK\x05\x06") else []


class _Opened:
    """An archive that is open for its entries; the directory of a ZIP file is read once, however many entries follow."""

    def __init__(self, archive: str):
        system, at = opened(archive)
        self.archive, self.f, self.zip, self.heads = archive, system.open_input_file(at), None, {}

    def _unzipped(self, entry: Entry) -> bytes:
        if self.zip is None:
            self.zip = zipfile.ZipFile(self.f)
            self.heads = {i.header_offset: i for i in self.zip.infolist()}
        # by place, as several entries may have one name
        with self.zip.open(self.heads.get(entry.parts[0].start, entry.path)) as e:
            return e.read()

    def content(self, entry: Entry) -> bytes:
        """The bytes of an entry."""
        try:
            self.f.seek(entry.parts[0].start if entry.parts else 0)
            if entry.parts and self.f.read(4) == b"PK\x03\x04":
                return self._unzipped(entry)
            pieces = []
            for p in entry.parts:
                raw = _exactly(self.f, p.start, p.packed)
                pieces.append(zlib.decompress(raw) if p.deflated else raw)
        except (zlib.error, zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
            raise Broken(f"{entry.archive}: {entry.path}: {e}") from e
        found = b"".join(pieces)
        if entry.adler is not None and zlib.adler32(found) != entry.adler:
            raise Broken(f"{entry.archive}: {entry.path}: checksum")
        return found

    def close(self) -> None:
        self.f.close()


@dataclass
class Archive(InputPartition):
    path: str


class _Reader(DataSourceReader):
    """The directories at a path, one to a task. place adds up the bytes of the entries before, in the order in which they lie."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Archive]:
        return [Archive(_whole(self.path, f.path)) for f in files_below(self.path)] or [Archive("")]

    def read(self, partition: Archive):
        place = 0
        for e in sorted(entries(partition.path) if partition.path else [], key=lambda e: e.parts[0].start if e.parts else 0):
            yield e.archive, e.path, e.size, place, [(p.start, p.packed, p.deflated) for p in e.parts], e.adler
            place += e.size


def _whole(given: str, at: str) -> str:
    """The address of a file that was found at or below a given address."""
    _, top = opened(given)
    return given.rstrip("/") + at[len(top.rstrip("/")) :] if at.startswith(top.rstrip("/")) else at


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """One ZIP file for each task, named when all are whole; a failed write leaves none."""

    def __init__(self, options: dict, overwrite: bool):
        import uuid

        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        system, top = opened(self.path)
        system.create_dir(f"{top}/_{self.job}")
        name = f"_{self.job}/{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.zip"
        rows = 0
        with system.open_output_stream(f"{top}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in iterator:
                for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                    z.writestr(zipfile.ZipInfo(path), data or b"", zipfile.ZIP_DEFLATED)
                    rows += 1
        return Written([name] if rows else [])

    def commit(self, messages) -> None:
        system, top = opened(self.path)
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{top}/{name}", f"{top}/{self.job}-{name.rpartition('/')[2].partition('-')[0]}.zip")
        system.delete_dir(f"{top}/_{self.job}")

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        system, top = opened(self.path)
        if system.get_file_info(f"{top}/_{self.job}").type == FileType.Directory:
            system.delete_dir(f"{top}/_{self.job}")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, overwrite)


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """The directories (LISTING) of the archives at a path: a file, or all files below a folder; files of other kinds have no rows."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").load(path)


def contents(listing: DataFrame, share_bytes: int = SHARE_BYTES, permissive: bool = False) -> DataFrame:
    """(archive, path, size, content, problem) of the entries in a listing; nothing else of their archives is read.

    An entry that does not unpack or does not match its checksum (it may be encrypted) is an error; if permissive, its content is null
    and problem says why.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["archive", "path", "size", "content", "problem"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["archive"] != now.archive:
                    if now:
                        now.close()
                    now = _Opened(r["archive"])
                entry = Entry(now.archive, r["path"], r["size"], tuple(Part(**p) for p in r["parts"]), r["adler"])
                found, problem = None, None
                try:
                    found = now.content(entry)
                except Broken as e:
                    if not permissive:
                        raise
                    problem = str(e)
                rows.append((entry.archive, entry.path, entry.size, found, problem))
                held += len(found or b"")
                # entries may be large, so batches end by their bytes
                if held >= BATCH_BYTES or len(rows) >= BATCH_ENTRIES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)
        if now:
            now.close()

    dealt = listing.withColumn("share", F.floor(F.col("place") / share_bytes)).repartition("archive", "share").sortWithinPartitions("archive", "place")
    return dealt.select("archive", "path", "size", "parts", "adler").mapInArrow(run, CONTENTS)


def write_archives(files: DataFrame, path: str) -> None:
    """files (path, content BINARY) as ZIP files below a folder, one for each partition that has rows."""
    files.sparkSession.dataSource.register(ArchiveSource)
    files.select("path", "content").write.format("archive").mode("append").save(path)


def scenario_files(files: DataFrame) -> DataFrame:
    """The scenario scripts among files with a path."""
    return files.where(F.col("path").startswith("data/") & F.col("path").endswith(".ks"))
