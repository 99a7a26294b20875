"""Words of whole Arrow string columns as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than ASCII white space (space, tab to carriage return), which in UTF-8 is the same
as a run of code points other than these. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _ensure_powers(n: int) -> None:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", _BASE), ("_inverse_powers", _BASE_INVERSE)):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            globals()[name] = np.cumprod(values)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1) of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each (one longer row makes a range of its own)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of rows lo to hi of a column; row is counted from lo, start and end in bytes from base."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bytes: np.ndarray
    bounds: np.ndarray  # word index at which each row begins, length rows + 1

    def __len__(self) -> int:
        return len(self.row)


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, fold: bool = True, breaks: bytes = b"", accents: bool = False, letters: np.ndarray | None = None) -> Words:
    """The words of rows lo to hi. fold: A-Z count as a-z; accents: so do U+00C0 to U+00DE. breaks: more bytes that end words.
    letters: by byte, what words are made of, in place of all but white space."""
    base = int(offsets[lo])
    raw = data[base : int(offsets[hi])]
    text = LOWER[raw] if fold else raw
    if accents and len(raw):
        wide = np.append(False, raw[:-1] == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        text[wide] += 32
    inside = ~SPACE[text] if letters is None else letters[text]
    for b in breaks:
        inside &= text != b
    n = len(text)
    begins = (offsets[lo:hi] - base).astype(np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[begins[begins < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cuts = begins[(begins > 0) & (begins <= n)] - 1
    after[cuts] = False
    end = np.flatnonzero(inside & ~after) + 1
    _ensure_powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=total[1:])
    value = (total[end] - total[start]) * _inverse_powers[start]
    row = np.searchsorted(begins, start, "right") - 1
    bounds = np.searchsorted(row, np.arange(hi - lo + 1), "left")
    return Words(row, start, end, mix(value), text, bounds)


_WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64), 77) | np.uint64(1)


def window_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each run of k words inside one row."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    value = np.zeros(n, np.uint64)
    for j in range(k):
        value += w.hash[j : j + n] * _WEIGHTS[j % 256]
    return at, mix(value[at], k)


def short_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with 1 to k - 1 words, and a hash of their whole sequence."""
    count = np.diff(w.bounds)
    rows = np.flatnonzero((count > 0) & (count < k))
    value = np.zeros(len(rows), np.uint64)
    for j in range(k - 1):
        has = count[rows] > j
        value[has] += w.hash[w.bounds[rows[has]] + j] * _WEIGHTS[j % 256]
    return rows, mix(value ^ count[rows].astype(np.uint64), 0)


def row_sets(w: Words, rows: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with words, and its sorted distinct shingle hashes (fewer than k words: one of the whole row)."""
    at, value = window_hashes(w, k)
    short, short_value = short_hashes(w, k)
    of = w.row[at]
    cut = np.searchsorted(of, np.arange(rows + 1), "left")
    for r in np.flatnonzero(np.diff(cut)):
        yield int(r), np.unique(value[cut[r] : cut[r + 1]])
    for r, v in zip(short, short_value, strict=True):
        yield int(r), np.array([v], np.uint64)
