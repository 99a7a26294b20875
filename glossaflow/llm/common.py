"""Helpers of the operators in this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table

__all__ = ["arrow_rows", "checkpoint", "documents", "fresh", "held_out", "map_batches", "only", "stored", "swept", "table"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names; anything else of the input, clashing names included, is left behind."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(x for i in range(len(taken) + 1) if (x := f"{name}_{i}" if i else name).lower() not in taken)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that the cluster names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Fewer rows an Arrow batch for what is run inside (wide rows); the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go at the end of each action, not when the driver's garbage is collected.

    No action ends there while a stage of it still runs, as AQE's end of joins with an empty side does: the tasks would wait for files that have gone.
    """
    sweep, rules = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.optimizer.excludedRules"
    before = {sweep: spark.conf.get(sweep, "false"), rules: spark.conf.get(rules, None)}
    spark.conf.set(sweep, "true")
    spark.conf.set(rules, ",".join(filter(None, [before[rules], "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"])))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def stage_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return f"{top}/stage-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of stage_folder(), on whatever file system it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df by way of a table in the shared folder (path: a stage_folder()): its lineage is cut, and it is computed once."""
    path = path or stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
