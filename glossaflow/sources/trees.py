"""Folders of files: listings, manifests and checksums, copies with exclusions, and restoring from a copy.

Format `tree` reads the listing of a folder (each folder right below it is listed by a task of its own) and writes files into one. Tasks copy or
write into a folder of the job beside the others; the driver moves the files to their places when all are whole, so a failed job leaves
nothing. Files are copied and hashed in blocks, so their size does not matter; checksums that add up are taken range by range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.text import matches_any
from .folders import opened

LISTING = "path STRING, kind STRING, size BIGINT, mtime_ns BIGINT"
BLOCK = 1 << 20
RANGE = 64 << 20
#: The largest prime below 2^16, the modulus of Adler-32.
ADLER = 65521


class NotEmpty(ValueError):
    """A target folder that holds something already."""


@dataclass
class Below(InputPartition):
    path: str
    deep: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[Below]:
        system, top = opened(self.root)
        found = system.get_file_info(FileSelector(top, allow_not_found=True))
        return [Below(top, False), *(Below(f.path, True) for f in found if f.type == FileType.Directory)]

    def read(self, partition: Below):
        system, top = opened(self.root)
        found = system.get_file_info(FileSelector(partition.path, recursive=partition.deep, allow_not_found=True))
        if partition.deep:
            found.append(system.get_file_info(partition.path))
        for f in found:
            if f.type == FileType.File or (f.type == FileType.Directory and partition.deep):
                kind = "file" if f.type == FileType.File else "folder"
                yield f.path[len(top.rstrip("/")) + 1 :], kind, f.size if kind == "file" else None, f.mtime_ns


@dataclass
class Done(WriterCommitMessage):
    put: list[str]
    gone: list[str]


class _Writer(DataSourceArrowWriter):
    """Rows (path, content) or (path, source: what to copy, null for a folder), and (path, gone: true) for what is to be deleted."""

    def __init__(self, options: dict):
        import uuid

        self.root, self.job = options["path"].rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def write(self, iterator) -> Done:
        from pyspark import TaskContext

        system, top = opened(self.root)
        own = f"{top}/{self.job}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        system.create_dir(own)
        done = Done([], [])
        for batch in iterator:
            names = batch.schema.names
            for r in batch.to_pylist():
                if r.get("gone"):
                    done.gone.append(r["path"])
                    continue
                at = f"{own}/{r['path']}"
                if "source" in names and r["source"] is None:
                    system.create_dir(at)
                else:
                    system.create_dir(at.rpartition("/")[0])
                    with system.open_output_stream(at) as out:
                        for block in _blocks(r["source"]) if "source" in names else (r["content"] or b"",):
                            out.write(block)
                done.put.append(f"{own[len(top) + 1 :]}/{r['path']}")
        return done

    def commit(self, messages) -> None:
        system, top = opened(self.root)
        for m in messages:
            for name in sorted(m.put if m else []):  # a folder comes before what it holds
                place = f"{top}/{name.split('/', 2)[2]}"
                if system.get_file_info(f"{top}/{name}").type == FileType.Directory:
                    system.create_dir(place)
                else:
                    system.create_dir(place.rpartition("/")[0])
                    system.move(f"{top}/{name}", place)
            for name in m.gone if m else []:
                system.delete_file(f"{top}/{name}")
        system.delete_dir(f"{top}/{self.job}")

    def abort(self, messages) -> None:
        system, top = opened(self.root)
        if system.get_file_info(f"{top}/{self.job}").type == FileType.Directory:
            system.delete_dir(f"{top}/{self.job}")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


def _blocks(path: str) -> Iterator[bytes]:
    system, at = opened(path)
    with system.open_input_stream(at) as f:
        while block := f.read(BLOCK):
            yield block


def tree(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, kind, size, mtime_ns) of the files and folders below a root; path is relative. What a glob of `exclude` matches, by its path
    or its name, is left out (of an excluded folder only the folder itself). A missing root has no rows."""
    spark.dataSource.register(TreeSource)
    found = spark.read.format("tree").load(root)
    return found.where(~matches_any(F.col("path"), list(exclude))) if exclude else found


def _dealt(files: DataFrame) -> DataFrame:
    """Files spread over tasks: in the order of a hash, so many large ones do not meet."""
    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return files.repartition(parts, "path")


def manifest(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, size, mtime_ns, sha256) of the files below a root, each read in blocks by one task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch["path"].to_pylist():
                state = hashlib.sha256()
                for block in _blocks(f"{root.rstrip('/')}/{path}"):
                    state.update(block)
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "sha256"])

    files = tree(spark, root, exclude).where("kind = 'file'").select("path", "size", "mtime_ns")
    return _dealt(files).mapInArrow(run, "path STRING, size BIGINT, mtime_ns BIGINT, sha256 STRING")


def adler_sums(data: np.ndarray) -> tuple[int, int]:
    """Of a block of bytes: their sum, and their sum weighted by how many stand from each to the end; both modulo ADLER."""
    n = len(data)
    weights = np.arange(n, 0, -1, dtype=np.uint64)
    return int(data.sum(dtype=np.uint64)) % ADLER, int((data * weights).sum(dtype=np.uint64)) % ADLER


def checksums(spark: SparkSession, root: str, exclude: Sequence[str] = (), range_bytes: int = RANGE) -> DataFrame:
    """(path, size, adler32) of the files below a root; a file's ranges are read by many tasks, and their sums added up in any order."""
    files = tree(spark, root, exclude).where("kind = 'file'").select("path", "size")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    ranges = files.select("path", "size", at.alias("at"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                system, place = opened(f"{root.rstrip('/')}/{r['path']}")
                one = two = 0
                with system.open_input_file(place) as f:
                    f.seek(r["at"])
                    left = min(range_bytes, r["size"] - r["at"])
                    while left and (block := f.read(min(left, BLOCK))):
                        s, t = adler_sums(np.frombuffer(block, np.uint8))
                        two = (two + t + len(block) * one) % ADLER  # what stands before the block counts once more for each of its bytes
                        one, left = (one + s) % ADLER, left - len(block)
                rows.append((r["path"], r["size"], r["at"], one, two))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "size", "at", "one", "two"]) if rows else batch.slice(0, 0)

    sums = ranges.repartition(parts, "path", "at").mapInArrow(run, "path STRING, size BIGINT, at BIGINT, one BIGINT, two BIGINT")
    return merged_adler(sums, range_bytes)


def merged_adler(sums: DataFrame, range_bytes: int) -> DataFrame:
    """(path, size, adler32) from the sums (path, size, at, one, two) of ranges of so many bytes, the last one of a file shorter."""
    behind = F.greatest(F.col("size") - F.col("at") - range_bytes, F.lit(0)) % ADLER
    both = sums.groupBy("path", "size").agg(F.sum("one").alias("one"), F.sum((F.col("two") + behind * F.col("one")) % ADLER).alias("two"))
    low, high = (F.lit(1) + F.col("one")) % ADLER, (F.col("size") + F.col("two")) % ADLER
    return both.select("path", "size", (high * 65536 + low).alias("adler32"))


def write_tree(files: DataFrame, root: str) -> None:
    """files (path, content BINARY) as files below a root; those that are there are replaced."""
    files.sparkSession.dataSource.register(TreeSource)
    files.select("path", "content").write.format("tree").mode("append").save(root)


def copy_tree(spark: SparkSession, source: str, target: str, exclude: Sequence[str] = ()) -> None:
    """Copy what is below source, but for excluded paths, to a target that must be missing or empty."""
    system, at = opened(target)
    if system.get_file_info(at).type != FileType.NotFound and system.get_file_info(FileSelector(at)):
        raise NotEmpty(target)
    found = tree(spark, source, exclude)
    origin = F.when(F.col("kind") == "file", F.concat(F.lit(source.rstrip("/") + "/"), "path"))
    _dealt(found.select("path", origin.alias("source"))).write.format("tree").mode("append").save(target)


def restore(spark: SparkSession, root: str, before: DataFrame, copy: str) -> DataFrame:
    """Bring the files below a root back to a manifest (path, sha256), from a copy of that time: changed and missing files are copied, new ones
    deleted. Gives what was done: (path, action), `copied` or `deleted`. Folders stay."""
    now = manifest(spark, root).select("path", F.col("sha256").alias("_now"))
    old = before.select("path", F.col("sha256").alias("_old"))
    action = F.when(F.col("_old").isNull(), "deleted").when(F.col("_now").isNull() | (F.col("_now") != F.col("_old")), "copied")
    todo = old.join(now, "path", "full_outer").select("path", action.alias("action")).where("action IS NOT NULL")
    from ..session import checkpoint

    todo = checkpoint(todo)
    origin = F.when(F.col("action") == "copied", F.concat(F.lit(copy.rstrip("/") + "/"), "path"))
    _dealt(todo.select("path", origin.alias("source"), (F.col("action") == "deleted").alias("gone"))).write.format("tree").mode("append").save(root)
    return todo
