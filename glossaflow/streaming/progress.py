"""Heartbeats of streaming queries: a listener that keeps a record of each run, and the records as task rows for a progress display.

A record is one small JSON file for each run, below a shared folder, written anew at most every `every` seconds while the query moves
and once when it ends. A run that is heard of no more stays `running` in its file; listing.task_snapshot() calls it interrupted once
its last heartbeat is too old.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.listing import task_snapshot
from ..session import Files

RECORD = "id STRING, name STRING, state STRING, started DOUBLE, updated DOUBLE, batches BIGINT, rows BIGINT, error STRING"
HEARTBEAT_SECONDS = 2.0


class ProgressRecords(StreamingQueryListener):
    """Add it with spark.streams.addListener(); it hears all queries of the session."""

    def __init__(self, spark: SparkSession, path: str, every: float = HEARTBEAT_SECONDS, clock=time.time):
        self.files, self.path, self.every, self.clock = Files(spark, path), path.rstrip("/"), every, clock
        self.files.folder(self.path)
        self.runs: dict[str, dict] = {}

    def _keep(self, run: str, at_once: bool = False, **changes) -> None:
        now = self.clock()
        record = self.runs.setdefault(run, {"id": run, "name": None, "state": "running", "started": now, "updated": 0.0, "batches": 0, "rows": 0, "error": None})
        record.update(changes)
        if at_once or now - record["updated"] >= self.every:
            record["updated"] = now
            self.files.write(f"{self.path}/{run}.json", json.dumps(record).encode())

    def onQueryStarted(self, event) -> None:
        self._keep(str(event.runId), True, name=event.name)

    def onQueryProgress(self, event) -> None:
        run, progress = str(event.progress.runId), event.progress
        seen = self.runs.get(run, {"batches": 0, "rows": 0})
        self._keep(run, name=progress.name, batches=seen["batches"] + 1, rows=seen["rows"] + (progress.numInputRows or 0))

    def onQueryIdle(self, event) -> None:
        self._keep(str(event.runId))

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self._keep(run, True, state="failed" if event.exception else "complete", error=(event.exception or None) and event.exception[:200])
        self.runs.pop(run, None)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORD) below a folder; files that are no record are left out."""
    return spark.read.schema(f"{RECORD}, _broken STRING").option("columnNameOfCorruptRecord", "_broken").json(path).where("id IS NOT NULL").drop("_broken")


def snapshot(spark: SparkSession, path: str, now: float, stale_seconds: float = 30.0, most: int = 30) -> DataFrame:
    """The latest runs, active ones first; see task_snapshot()."""
    return task_snapshot(records(spark, path), stale_seconds, now, most)
