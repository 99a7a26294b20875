"""Session and table helpers shared by the library."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "glossaflow", cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster pass your own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("GLOSSAFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; set a folder of our own only in local mode (tests). On a cluster, where a local
    folder would not be shared, none is an error."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glossaflow-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that the cluster names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return f"{top}/{name}-{uuid.uuid4().hex}"


class Files:
    """Whole files and folders on whatever file system a path names, by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def folder(self, path: str) -> None:
        self._system.mkdirs(self._path(path))

    def mark(self, path: str) -> None:
        """An empty file; one that is there already is an error."""
        self._system.create(self._path(path), False).close()

    def write(self, path: str, data: bytes) -> None:
        """A small file, in the place of the one that was there."""
        out = self._system.create(self._path(path), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def remove(self, path: str) -> None:
        self._system.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._path(path))) if self.exists(path) else []
