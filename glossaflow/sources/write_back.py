"""Translations put back into JSON documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import json_walk


def _put(value, keys: list[str], target: str) -> None:
    """Set the text at a path. A key that holds the separator itself is tried as one, the longest first."""
    if isinstance(value, list):
        at, used = int(keys[0]), 1
    else:
        used = next(n for n in range(len(keys), 0, -1) if "/".join(keys[:n]) in value)
        at = "/".join(keys[:used])
    if used == len(keys):
        value[at] = target
    else:
        _put(value[at], keys[used:], target)


def _rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for body, edits in zip(batch["text"], batch["edits"], strict=True):
            value = json.loads(body.removeprefix("﻿"))
            for edit in edits:
                _put(value, edit["path"].split("/"), edit["target"])
            out.append(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
        yield pd.DataFrame({"file": batch["file"], "text": out, "n_edits": [len(e) for e in batch["edits"]]})


def write_back(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, text, n_edits) of JSON documents (file, text) with edits (file, path, target), paths as json_walk.leaves() gives
    them. Documents without an edit stay as they are; the others are written without spaces."""
    per_file = edits.groupBy("file").agg(F.collect_list(F.struct("path", "target")).alias("edits"))
    changed = docs.join(per_file, "file").select("file", "text", "edits").mapInPandas(_rewritten, "file STRING, text STRING, n_edits BIGINT")
    return changed.unionByName(docs.join(per_file, "file", "left_anti").select("file", "text", F.lit(0).cast("bigint").alias("n_edits")))


def translate_fields(docs: DataFrame, translations: DataFrame) -> DataFrame:
    """write_back() of the display fields of data files (file, text) that have a translation (source, target) other than themselves."""
    found = json_walk.display_fields(docs.select("file", json_walk.parsed(F.col("text")).alias("value")))
    pairs = translations.where("source <> target").groupBy("source").agg(F.max("target").alias("target"))
    return write_back(docs, found.join(pairs, found["text"] == pairs["source"]).select("file", "path", "target"))


def replace_files(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """files (path, content) with those of overrides in their place; replaced tells which."""
    over = overrides.select("path", F.col("content").alias("_over"))
    joined = files.join(over, "path", "left")
    return joined.select("path", F.coalesce("_over", "content").alias("content"), F.col("_over").isNotNull().alias("replaced"))


def unknown_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """(path) of overrides without a file, which a caller should take as an error."""
    return overrides.select("path").join(files.select("path"), "path", "left_anti")
