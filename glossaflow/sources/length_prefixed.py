"""Texts with their length in front of them, found in BINARY columns of unknown layout.

All offsets of a row are looked at together. A length of four bytes (little-endian) is taken at each; its range holds UTF-8 if it begins and
ends between characters and no byte in it is wrong, which running sums over the bytes tell for all ranges at once. What remains is
judged as a candidate by Spark. Last, rows sorted by place go through a choice that keeps the leftmost and skips what it covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_candidate

LEAST, MOST_RESOURCE, MOST_ASSET = 2, 4096, 8192
#: What a task holds of found texts before they go on.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 4_000


def utf8_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether it is wrong as UTF-8 (no shortest forms, surrogates or codes past U+10FFFF), and whether it lies inside a character."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    one, two, three, four = (padded[i : n + i] for i in range(4))
    tail = lambda b: (b & 0xC0) == 0x80
    low = np.select([one == 0xE0, one == 0xF0], [0xA0, 0x90], 0x80)
    high = np.select([one == 0xED, one == 0xF4], [0x9F, 0x8F], 0xBF)
    second = (two >= low) & (two <= high)
    width = np.zeros(n, np.int8)
    width[one < 0x80] = 1
    width[(one >= 0xC2) & (one <= 0xDF) & second] = 2
    width[(one >= 0xE0) & (one <= 0xEF) & second & tail(three)] = 3
    width[(one >= 0xF0) & (one <= 0xF4) & second & tail(three) & tail(four)] = 4
    inside = np.zeros(n + 3, bool)
    for k in (1, 2, 3):
        inside[np.flatnonzero(width > k) + k] = True
    inside = inside[:n]
    return (width == 0) & ~inside, inside


def ranges(data: np.ndarray, least: int, most: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of all prefixes at multiples of step whose range is valid UTF-8."""
    n = len(data)
    at = np.arange(0, max(n - 3, 0), step)
    length = sum(data[at + i].astype(np.int64) << (8 * i) for i in range(4)) if len(at) else np.zeros(0, np.int64)
    fits = (length >= least) & (length <= most) & (at + 4 + length <= n)
    at, length = at[fits], length[fits]
    if not len(at):
        return at, length
    wrong, inside = utf8_marks(data)
    before = np.concatenate([[0], np.cumsum(wrong)])
    split = np.append(inside, False)
    begin, end = at + 4, at + 4 + length
    # a range that ends inside a character has it cut, one that begins inside has its rest alone
    fine = (before[end] == before[begin]) & ~split[begin] & ~split[end]
    return at[fine], length[fine]


def _found(column: pa.Array, least: int, most: int, step: int, shown: bool) -> Iterator[tuple[int, int, int, str]]:
    for row, raw in enumerate(column):
        data = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid and raw.as_buffer().size else np.zeros(0, np.uint8)
        for at, length in zip(*(x.tolist() for x in ranges(data, least, most, step)), strict=True):
            text = data[at + 4 : at + 4 + length].tobytes().decode()
            if shown:
                text = text.rstrip("\0")
                if not (text.isprintable() or "\n" in text):
                    continue
            if text:
                yield row, at, length, text


def _told(ids: pa.Array, rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    row, at, length, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(text, pa.string())], ["id", "at", "length", "text"])


def _pieces(batch: pa.RecordBatch, most: int, step: int, shown: bool) -> Iterator[pa.RecordBatch]:
    """(id, at, length, text) found in (id, content), some at a time: ranges may overlap, so a batch can have many more bytes of texts than of contents."""
    rows, held = [], 0
    for r in _found(batch.column(1), LEAST, most, step, shown):
        rows.append(r)
        held += r[2]
        if held >= PIECE_BYTES or len(rows) >= PIECE_ROWS:
            yield _told(batch.column(0), rows)
            rows, held = [], 0
    if rows:
        yield _told(batch.column(0), rows)


def probe(df: DataFrame, lang: str, asset: bool = False, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, at, text) of the texts in each row's content that are candidates of a language, none overlapping another.

    Resource files: every offset, up to MOST_RESOURCE bytes, NULs at the end do not count, and the text must be printable or have several
    lines. asset: every fourth offset, up to MOST_ASSET bytes, and a text takes a multiple of four bytes. Of overlapping texts the leftmost
    stays. Null and empty contents have none; ids should be unique.
    """
    kind = dict(df.dtypes)[id_col]
    most, step = (MOST_ASSET, 4) if asset else (MOST_RESOURCE, 1)

    def look(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pieces(batch, most, step, not asset)

    def choose(batches) -> Iterator[pa.RecordBatch]:
        now, free = None, 0
        for batch in batches:
            keep = []
            for i, at, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if i != now:
                    now, free = i, 0
                fits = at >= free
                keep.append(fits)
                if fits:
                    free = at + 4 + (-(-length // step) * step)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["id", "at", "text"])

    found = df.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).where("id IS NOT NULL").mapInArrow(look, f"id {kind}, at bigint, length bigint, text string")
    found = found.where(is_candidate(F.col("text"), lang)).repartition("id").sortWithinPartitions("id", "at")
    return found.mapInArrow(choose, f"id {kind}, at bigint, text string")
