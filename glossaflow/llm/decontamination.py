"""Benchmark decontamination by latent semantic retrieval.

Words (letters of Latin-1 in lower case, cut at punctuation) are hashed to BINS; idf comes from the number of passages of WINDOW words that have
the bin, counted over every document. Benchmark items are cut into passages of up to PASSAGE words. Their TF-IDF matrix A
has a randomised SVD: tasks add up A'A times a random matrix, the driver makes it orthonormal (a few words of the block's
vocabulary by RANK, a fixed size), once more for accuracy, then a RANK by RANK matrix of the projected passages
gives the directions V. Every window of WINDOW words of every document, a step of STEP words apart, is mapped to the same
space and compared with all passages of the items by cosine. A window whose words outside the items' vocabulary carry
so much weight that its cosine in the full space cannot reach CANDIDATE is passed over; that bound is exact.

Around a candidate window, the longest common subsequence of the words with the item's decides: NEAR of the item's words
in order are a leak; from PARAPHRASE on, it is one if the answer is there too: ANSWER of the last ANSWER_WORDS words of the
item, in order. (The benchmark table has no answer column; an item ends with its answer.)

Items come in blocks of ITEMS at most, each with a space of its own; one pass over the documents serves BLOCKS_AT_ONCE of them, so
what is broadcast is bounded, and only a benchmark of more than 32,000 items takes more passes.
Nulls and empty texts, and items without words, leak nothing; an empty table gives an empty result. Very long texts are read whole. Repeated
rows are each reported; of equally good stretches of one item the last one is named. Other columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts
from .common import checkpoint, only
from .wordhash import Words, column_buffers, slices, words

BINS = 1 << 18
WINDOW, STEP = 32, 8
PASSAGE = 24
RANK = 192
ITEMS = 2_000
#: Blocks of items for which one pass over the documents is made (some 20 MB each in every task).
BLOCKS_AT_ONCE = 16
CANDIDATE = 0.5
NEAR, PARAPHRASE, ANSWER = 0.8, 0.55, 0.75
ANSWER_WORDS = 8
PUNCTUATION = b".,;:!?()[]{}\"'"


def _words(column: pa.Array):
    data, offsets = column_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, words(data, offsets, lo, hi, breaks=PUNCTUATION, accents=True)


def _bins(w: Words) -> np.ndarray:
    return (w.hash % np.uint64(BINS)).astype(np.int64)


def passage_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many passages of WINDOW words of (text) have each bin, and how many passages there are."""

    def run(batches):
        from pyspark import TaskContext

        found, total = np.zeros(BINS + 1, np.int64), 0
        for batch in batches:
            for _, w in _words(batch.column(0)):
                place = (np.arange(len(w)) - w.bounds[w.row]) // WINDOW
                per = -(-np.diff(w.bounds) // WINDOW)
                passage = np.append(0, np.cumsum(per))[w.row] + place
                key = np.sort(passage * BINS + _bins(w))
                key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
                found += np.bincount(key % BINS, minlength=BINS + 1)
                total += int(per.sum())
        found[BINS] = total
        blocks = counts.packed(found)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["task", "block", "counts"])

    found = counts.merged(checkpoint(docs.select("text").mapInArrow(run, "task int, block int, counts binary")), BINS + 1)
    return found[:BINS], int(found[BINS])


def item_passages(items: DataFrame) -> DataFrame:
    """(item, words, bins) of (item, text): each passage's bins; the first passage of an item also has all its word hashes."""

    def run(batches):
        for batch in batches:
            at, bins, whole = [], [], []
            for lo, w in _words(batch.column(1)):
                found = _bins(w)
                for r in range(len(w.bounds) - 1):
                    a, b = int(w.bounds[r]), int(w.bounds[r + 1])
                    starts = range(a, max(b - PASSAGE, a) + 1, PASSAGE // 2) if b > a else ()
                    for s in sorted({*starts, max(b - PASSAGE, a)} if b > a else ()):
                        at.append(lo + r)
                        bins.append(found[s : min(s + PASSAGE, b)].astype("<i4").tobytes())
                        whole.append(w.hash[a:b].tobytes() if s == a else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(whole, pa.binary()), pa.array(bins, pa.binary())], ["item", "words", "bins"])

    return items.mapInArrow(run, "item bigint, words binary, bins binary")


@dataclass
class Space:
    """The latent space of one block of items."""

    idf: np.ndarray
    place: np.ndarray  # of each bin in the vocabulary, or -1
    directions: np.ndarray  # vocabulary by rank
    latent: np.ndarray  # passages by rank, of length 1
    item_of: np.ndarray  # of each passage, an index into items
    items: list[int]
    item_words: list[np.ndarray]

    def __post_init__(self) -> None:
        self.item_sets = [np.unique(x, return_counts=True) for x in self.item_words]


def _sparse(bins: bytes, place: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b, tf = np.unique(np.frombuffer(bins, "<i4"), return_counts=True)
    return place[b], (tf * idf[b]).astype(np.float32)


def _add_up(rows: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """The sum over passages of make(list of bins), a matrix of `shape`: partial sums by task, added by row blocks."""
    height = 4096

    def run(batches):
        total = np.zeros(shape, np.float32)
        for batch in batches:
            total += make(batch.column(0).to_pylist())
        blocks = [total[b : b + height].tobytes() for b in range(0, shape[0], height)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for p in pdf["part"]:
            total = total + np.frombuffer(p, np.float32).astype(np.float64)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "part": [total.astype(np.float32).tobytes()]})

    parts = rows.select("bins").mapInArrow(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary")
    out = np.zeros(shape, np.float32)
    for r in parts.collect():
        part = np.frombuffer(bytes(r["part"]), np.float32).reshape(-1, shape[1])
        out[r["block"] * height : r["block"] * height + len(part)] = part
    return out


def fit(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> Space:
    """Randomised SVD of one block's passages (item, words, bins)."""
    rows = passages.collect()  # a block: at most ITEMS items
    rows.sort(key=lambda r: (r["item"], bytes(r["bins"])))
    vocabulary = np.unique(np.concatenate([np.frombuffer(bytes(r["bins"]), "<i4") for r in rows]))
    place = np.full(BINS, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    rank = min(rank, len(vocabulary), len(rows))
    context = passages.sparkSession.sparkContext
    fixed = context.broadcast((place, idf))

    def products(basis: np.ndarray, both: bool):
        shared = context.broadcast(basis)

        def make(batch: list[bytes]) -> np.ndarray:
            q = shared.value
            out = np.zeros(q.shape if both else (q.shape[1], q.shape[1]), np.float32)
            for bins in batch:
                at, value = _sparse(bins, *fixed.value)
                y = value @ q[at]
                if both:
                    out[at] += value[:, None] * y[None, :]
                else:
                    out += y[:, None] * y[None, :]
            return out

        return make

    basis = np.random.default_rng(seed).normal(size=(len(vocabulary), rank)).astype(np.float32)
    for _ in range(2):
        image = _add_up(passages, products(basis, True), basis.shape)
        basis = np.linalg.qr(image.astype(np.float64))[0].astype(np.float32)
    inner = _add_up(passages, products(basis, False), (rank, rank))
    _, turn = np.linalg.eigh(inner.astype(np.float64))
    directions = (basis @ turn[:, ::-1].astype(np.float32)).astype(np.float32)
    latent = np.stack([value @ directions[at] for at, value in (_sparse(bytes(r["bins"]), place, idf) for r in rows)])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    items = sorted({r["item"] for r in rows})
    index = {x: i for i, x in enumerate(items)}
    whole = {r["item"]: np.frombuffer(bytes(r["words"]), np.uint64) for r in rows if r["words"] is not None}
    return Space(idf, place, directions, latent.astype(np.float32), np.array([index[r["item"]] for r in rows]), items, [whole[x] for x in items])


def common_subsequence(item: list[int], text: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence, and of the part of it within the item's last ANSWER_WORDS words.

    Bits of one integer hold a column of the usual table; a word takes one addition.
    """
    masks: dict[int, int] = {}
    for i, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    state = full
    for x in text:
        if (m := masks.get(x)) is not None:
            u = state & m
            state = ((state + u) | (state - u)) & full
    found = full & ~state
    return found.bit_count(), (found >> max(len(item) - ANSWER_WORDS, 0)).bit_count()


def _windows(space: Space, w: Words, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of the windows that can reach CANDIDATE: most of their weight is on words of the items."""
    weight = space.idf[bins].astype(np.float64) ** 2
    energy, inside = np.append(0, np.cumsum(weight)), np.append(0, np.cumsum(weight * (space.place[bins] >= 0)))
    count = np.diff(w.bounds)
    steps = np.maximum(-(-(count - WINDOW) // STEP), 0) + 1
    steps[count == 0] = 0
    row = np.repeat(np.arange(len(count)), steps)
    start = w.bounds[row] + STEP * (np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(steps)[:-1]), steps))
    end = np.minimum(start + WINDOW, w.bounds[row + 1])
    can = (inside[end] - inside[start]) >= CANDIDATE**2 * (energy[end] - energy[start]) * 0.999
    can &= inside[end] > inside[start]
    return row[can], start[can]


def _near_passages(space: Space, w: Words, bins: np.ndarray, row: np.ndarray, start: np.ndarray, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of windows and of the passages of items whose cosine with them reaches CANDIDATE.

    Windows overlap, so the latent vectors are summed by stretches of STEP words, each once, and then by the stretches of a window.
    """
    place = space.place[bins]
    for lo in range(0, len(start), at_once):
        some, of = start[lo : lo + at_once], row[lo : lo + at_once]
        ahead = some[:, None] + np.arange(0, WINDOW, STEP)
        stretch, back = np.unique(np.minimum(ahead, w.bounds[of + 1][:, None]), return_inverse=True)
        ends = np.minimum(stretch + STEP, w.bounds[np.minimum(np.searchsorted(w.bounds, stretch, "right"), len(w.bounds) - 1)])
        word = stretch[:, None] + np.arange(STEP)
        inside = word < ends[:, None]
        word = np.where(inside, word, 0)
        known = inside & (place[word] >= 0)
        weight = np.where(known, space.idf[bins[word]], np.float32(0))
        sums = np.zeros((len(stretch) + 1, space.directions.shape[1]), np.float32)
        np.matmul(weight[:, None, :], space.directions[np.where(known, place[word], 0)], out=sums[:-1, None, :])
        # a stretch at the end of its row is empty
        back = np.where(ahead < w.bounds[of + 1][:, None], back.reshape(ahead.shape), len(stretch))
        latent = sums[back].sum(axis=1)
        cosine = latent @ space.latent.T
        hits = np.nonzero(cosine >= CANDIDATE * np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9))
        yield lo + hits[0], hits[1]


def _row_leaks(space: Space, w: Words, bins: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(row, item, start word, common share, answer share) of the leaks in the words of a slice."""
    if not len(w):
        return []
    row, starts = _windows(space, w, bins)
    near: dict[tuple[int, int], set[int]] = {}
    for window, passage in _near_passages(space, w, bins, row, starts):
        for r, i, s in zip(row[window].tolist(), space.item_of[passage].tolist(), starts[window].tolist(), strict=True):
            near.setdefault((r, i), set()).add(s)
    out = []
    for (r, i), at in near.items():
        item, (known_words, times) = space.item_words[i], space.item_sets[i]
        reach = len(item) + len(item) // 4
        least = PARAPHRASE * len(item)
        best = None
        done = -1
        for s in sorted(at):
            a = max(s - reach + STEP, int(w.bounds[r]), done)
            b = min(s + WINDOW + reach, int(w.bounds[r + 1]))
            done = max(done, s)
            # stretches of a length near the item's, so that common words strewn over a long text do not add up
            begin = np.arange(a, max(b - reach, a) + 1, max(len(item) // 8, 1))
            place = np.minimum(np.searchsorted(known_words, w.hash[a:b]), len(known_words) - 1)
            same = known_words[place] == w.hash[a:b]
            held = np.append(0, np.cumsum(same))
            # a stretch has no longer common subsequence than words of the item, each as often as the item has it
            for lo in begin[held[np.minimum(begin + reach, b) - a] - held[begin - a] >= least].tolist():
                inside = slice(lo - a, min(lo + reach, b) - a)
                if np.minimum(np.bincount(place[inside][same[inside]], minlength=len(times)), times).sum() < least:
                    continue
                common, answer = common_subsequence(item.tolist(), w.hash[lo : min(lo + reach, b)].tolist())
                share, answered = common / len(item), answer / min(ANSWER_WORDS, len(item))
                if share >= NEAR or share >= PARAPHRASE and answered >= ANSWER:
                    one = (share, answered, lo - int(w.bounds[r]))
                    best = one if best is None else max(best, one)
        if best is not None:
            out.append((r, i, best[2], best[0], best[1]))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, start_word, common, answer) of each document that holds an item."""
    texts = only(docs, id=id_col, text=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item bigint, start_word bigint, common double, answer double"
    passages = checkpoint(item_passages(only(benchmark, item=item_col, text=item_text).where("item IS NOT NULL").withColumn("item", F.col("item").cast("bigint"))))
    n_items = passages.select("item").distinct().count()
    if not n_items:
        return docs.sparkSession.createDataFrame([], schema)
    seen, total = passage_counts(texts)
    idf = np.log((total + 1) / (seen + 1.0)).astype(np.float32)
    blocks = -(-n_items // ITEMS)
    found = None
    for first in range(0, blocks, BLOCKS_AT_ONCE):  # no more spaces than one pass takes are held at once
        own = (passages.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) for block in range(first, min(first + BLOCKS_AT_ONCE, blocks)))
        spaces = [fit(mine, idf) for mine in own if not mine.isEmpty()]
        if spaces:
            part = _search(texts, spaces, schema)
            found = part if found is None else found.unionByName(part)
    return found


def _search(texts: DataFrame, spaces: list[Space], schema: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(spaces)

    def run(batches):
        for batch in batches:
            found = []
            for lo, w in _words(batch.column(1)):
                bins = _bins(w)
                found += [(lo + r, space.items[i], *rest) for space in shared.value for r, i, *rest in _row_leaks(space, w, bins)]
            at, items, start, common, answer = zip(*found, strict=True) if found else ((),) * 5
            columns = [pa.array(items, pa.int64()), pa.array(start, pa.int64()), pa.array(common, pa.float64()), pa.array(answer, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["id", "item", "start_word", "common", "answer"])

    return texts.mapInArrow(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item of the benchmark; columns as in docs."""
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
