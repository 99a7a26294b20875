"""Vectors of counts that tasks fill and Spark adds up: a fixed size, however many rows were counted."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: Vectors added up by one task; more are added up in rounds.
MERGE_AT_ONCE = 256


def packed(vector: np.ndarray) -> list[bytes]:
    """A vector of counts in blocks of BLOCK, compressed."""
    return [zlib.compress(np.minimum(vector[b : b + BLOCK], 2**32 - 1).astype("<u4").tobytes(), 1) for b in range(0, len(vector), BLOCK)]


def _unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(block), "<u4")


def merged(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors, from rows (task, block, counts)."""

    def add(rows: pa.Table) -> pa.Table:
        total = 0
        for c in rows["counts"]:
            total = total + _unpacked(c.as_py()).astype(np.int64)
        task, block = (rows[c][0].as_py() for c in ("task", "block"))
        names = {"task": pa.array([task // MERGE_AT_ONCE], pa.int32()), "block": pa.array([block], pa.int32()), "counts": pa.array(packed(total)[:1], pa.binary())}
        return pa.table(names)

    vectors = rows.select("task", "block", "counts")
    tasks = (vectors.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        vectors = vectors.groupBy("block", (F.col("task") / MERGE_AT_ONCE).cast("int").alias("of")).applyInArrow(add, "task int, block int, counts binary")
        if tasks <= MERGE_AT_ONCE:
            break
        tasks = -(-tasks // MERGE_AT_ONCE)
    out = np.zeros(size, np.uint32)
    for r in vectors.collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = _unpacked(bytes(r["counts"]))
    return out
