"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

A text has the features x: the words (A-Z as a-z) hashed to WORD_BINS, with 1 + log(count) scaled to length 1, and
STATS statistics of its structure and size. The score is the logistic of
w0 + sum w_i x_i + (1/2) sum over factors of ((sum v_if x_i)^2 - sum v_if^2 x_i^2), linear in the number of features.
It is fitted by AdaGrad on at most FIT_ROWS labelled rows outside the held-out fifth and then scores every row.

Nulls and empty texts have no words, and get the score of their statistics. A table without labels of both kinds gives
their share, or 0.5 without labels; an empty table gives an empty result. Very long texts are read whole. Repeated rows get equal scores, and
rows of training that are alike count as often as they are there. Other columns, whatever their names, are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, only
from .labelled import training_rows
from .wordhash import column_buffers, slices, words

WORD_BINS = 1 << 15
FACTORS = 8
FIT_ROWS = 12_000
EPOCHS = 8
STATS = 12


@dataclass
class Rows:
    """Sparse rows: features of row r are index[bounds[r]:bounds[r + 1]]."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        count = np.diff(self.bounds)[rows]
        at = np.repeat(self.bounds[rows] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        return Rows(np.append(0, np.cumsum(count)), self.index[at], self.value[at])


def features(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Rows:
    w, rows = words(data, offsets, lo, hi), hi - lo
    raw = data[int(offsets[lo]) : int(offsets[hi])]
    begins = offsets[lo : hi + 1] - offsets[lo]
    key, count = np.unique(w.row * WORD_BINS + (w.hash % np.uint64(WORD_BINS)).astype(np.int64), return_counts=True)
    row, index = key // WORD_BINS, key % WORD_BINS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value**2, rows))
    value = value / norm[row]
    n_words = np.diff(w.bounds)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[begins[1:]] - total[begins[:-1]]

    n_bytes = np.maximum(np.diff(begins), 1)
    some = np.maximum(n_words, 1)
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    lines = per_row(raw == 10) + 1
    adjacent = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1]) if len(w) > 1 else np.zeros(0, bool)
    again = np.bincount(w.row[1:][adjacent], minlength=rows) if len(w) > 1 else np.zeros(rows)
    stats = np.stack(
        [
            np.ones(rows),
            4 * per_row((raw >= 65) & (raw <= 90)) / n_bytes,
            10 * per_row(symbols[raw]) / n_bytes,
            10 * per_row((raw >= 48) & (raw <= 57)) / n_bytes,
            10 * per_row(raw == 33) / n_bytes,
            5 * per_row((raw == 44) | (raw == 46)) / n_bytes,
            per_row((raw & 0xC0) != 0x80) / some / 10,
            1 - np.bincount(row, minlength=rows) / some,
            2 * again / some,
            10 * lines / some,
            np.log1p(n_words) / 8,
            (n_words < 50).astype(float),
        ],
        axis=1,
    )
    stats = np.clip(stats, 0, 3)
    at = np.arange(rows)
    row = np.concatenate([row, np.repeat(at, STATS)])
    index = np.concatenate([index, np.tile(WORD_BINS + np.arange(STATS), rows)])
    value = np.concatenate([value, stats.ravel()])
    order = np.argsort(row, kind="stable")
    return Rows(np.searchsorted(row[order], np.arange(rows + 1)), index[order].astype(np.int32), value[order].astype(np.float32))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, x: Rows) -> np.ndarray:
        """The sum-of-squares identity, row by row."""
        if not len(x.bounds) - 1:
            return np.zeros(0)
        scaled = self.factors[x.index] * x.value[:, None]
        sums = np.add.reduceat(scaled, x.bounds[:-1], axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), x.bounds[:-1])
        return self.bias + np.add.reduceat(self.weights[x.index] * x.value, x.bounds[:-1]) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def score(self, x: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: Rows, label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 2e-5, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    size = WORD_BINS + STATS
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    if not len(label):
        return Machine(0.0, m.weights, m.factors * 0)
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    m.bias = float(np.log(share / (1 - share)))
    if len(set(label.tolist())) < 2:
        return Machine(m.bias, m.weights, m.factors * 0)
    seen_w, seen_v = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            b = x.take(rows)
            count = np.diff(b.bounds)
            error = (m.score(b) - label[rows]) / len(rows)
            scaled = m.factors[b.index] * b.value[:, None]
            sums = np.add.reduceat(scaled, b.bounds[:-1], axis=0)
            each = np.repeat(error, count).astype(np.float32)
            part = each * b.value
            used, place = np.unique(b.index, return_inverse=True)
            grad_w = np.bincount(place, part, len(used)) + decay * m.weights[used]
            per = part[:, None] * (np.repeat(sums, count, axis=0) - scaled)
            grad_v = np.stack([np.bincount(place, per[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay * m.factors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            m.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            m.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            m.bias -= rate * float(error.sum())
    return m


def _feature_rows(df: DataFrame) -> DataFrame:
    """(label, index, value) of (id, text, label): the features of each row as bytes."""

    def run(batches):
        for batch in batches:
            data, offsets = column_buffers(batch.column(0))
            index, value = [], []
            for lo, hi in slices(offsets):
                x = features(data, offsets, lo, hi)
                for a, b in zip(x.bounds[:-1], x.bounds[1:], strict=True):
                    index.append(x.index[a:b].tobytes())
                    value.append(x.value[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["label", "index", "value"])

    return df.select("text", "label").mapInArrow(run, "label int, index binary, value binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Machine:
    rows = _feature_rows(training_rows(docs, labels, label, most)).collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["index"]), bytes(r["value"])))  # the same model whatever the order of arrival
    index = [np.frombuffer(bytes(r["index"]), np.int32) for r in rows]
    value = [np.frombuffer(bytes(r["value"]), np.float32) for r in rows]
    bounds = np.append(0, np.cumsum([len(i) for i in index])).astype(np.int64)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return fit(Rows(bounds, join(index, np.int32), join(value, np.float32)), np.array([r["label"] for r in rows], np.float64))


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            data, offsets = column_buffers(batch.column(1))
            parts = [shared.value.score(features(data, offsets, lo, hi)) for lo, hi in slices(offsets, 2 << 20)]
            found = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return only(df, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
