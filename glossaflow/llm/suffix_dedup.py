"""Repeated passages by a sparse suffix array over words.

Of the suffixes of every text only those at minimisers are kept: of each WINDOW runs of SEED words in a row, the one with the least
hash. These runs are the words of one passage of LEAST_WORDS = SEED + WINDOW - 1 words, so equal passages keep the same suffix, at the same
distance from their first word. The passages that keep one suffix begin at neighbouring words (WINDOW at most); together they are a
piece, and pieces of equal words are a class. Suffixes whose first SEED words occur once are put aside with a bitmap of a bounded
size. Classes (counted, with their first occurrence by id, then place) are brought together by the first SEED words, and
all the passages in them are counted by hash over the whole group, with the first occurrence of each. A group of more than
HEAVY suffixes is not held in one task: its passages are counted by Spark's aggregation, one row for each class and passage.

A passage with another occurrence marks its words as repeated; marks are merged to spans, and every occurrence of a passage
but the first is a removal. Both are exact but for equal 64-bit hashes of different words.

Words are A-Z as a-z. Nulls, empty tables and texts of fewer words have no spans; very long texts are read whole. Repeated rows are repeats of each other, but as spans go
by id, a place of one id is never removed for the same place of a repeated row. Null ids are left out, and so are other columns, whatever their names. Of equal occurrences the one with the least id, then the first place is the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import linkage
from .common import checkpoint, only
from .wordhash import Words, column_buffers, mix, slices, window_hashes, words

SEED = 16
WINDOW = 35
LEAST_WORDS = SEED + WINDOW - 1
#: Suffixes of one group that a task may hold.
HEAVY = 20_000
#: Groups that are handled apart; where more have over HEAVY suffixes, only those with over one in so many of all suffixes are.
MOST_HEAVY = 1_000_000

_ODD = mix(np.arange(1, 7, dtype=np.uint64), 78) | np.uint64(1)


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first word and hash of each run of SEED words; the runs that begin a passage, and the least run of each passage."""
    at, value = window_hashes(w, SEED)
    none = np.zeros(0, np.int64)
    if len(at) < WINDOW:
        return at, value, none, none
    # the runs of one row are neighbours in at; a window of runs must lie inside one row
    inside = np.flatnonzero(w.row[at[: len(at) - WINDOW + 1]] == w.row[at[WINDOW - 1 :]])
    if not len(inside):
        return at, value, none, none
    return at, value, inside, inside + sliding_window_view(value, WINDOW)[inside].argmin(axis=1)


def minimisers(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the kept runs of SEED words."""
    at, value, _, least = _windows(w)
    chosen = np.unique(least)
    return at[chosen], value[chosen]


def _slices(column: pa.Array) -> Iterator[tuple[int, Words]]:
    data, offsets = column_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, words(data, offsets, lo, hi)


def seeds(docs: DataFrame) -> DataFrame:
    """(seed) of all kept suffixes of (id, text)."""

    def run(batches):
        for batch in batches:
            for _, w in _slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(minimisers(w)[1].view(np.int64))], ["seed"])

    return docs.select("text").mapInArrow(run, "seed bigint")


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (length n + 1) of ranges of these sizes put in a row, and the members of all."""
    offsets = np.append(0, np.cumsum(size))
    return offsets, np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)


def pieces(docs: DataFrame, repeated, heavy, of_heavy: bool, whole: bool) -> DataFrame:
    """(seed, class, id, place, passages) of (id, text): the pieces whose seed is let through and is, or is not, heavy; the first
    word of a piece, and, where asked for, the hashes of its passages, which begin at this word and at those after it.

    repeated, heavy: broadcasts of a bitmap and of sorted seeds.
    """

    def run(batches):
        for batch in batches:
            for lo, w in _slices(batch.column(1)):
                at, value, inside, least = _windows(w)
                chosen, begin, size = np.unique(least, return_index=True, return_counts=True)
                seed = value[chosen].view(np.int64)
                keep = np.flatnonzero(linkage.let_through(repeated.value, seed) & (np.isin(seed, heavy.value) == of_heavy))
                seed, begin, size = seed[keep], begin[keep], size[keep]
                # four runs hold all the words of a passage, the last one ending with it
                passage = np.zeros(len(inside), np.uint64)
                for j, ahead in enumerate((*range(0, WINDOW - 1, SEED), WINDOW - 1)):
                    passage += value[inside + ahead] * _ODD[j]
                passage = mix(passage, LEAST_WORDS)
                # the first and the last passage hold all the words of a piece
                kind = mix(passage[begin] * _ODD[4] + passage[begin + size - 1] * _ODD[5] + size.astype(np.uint64), 79)
                first = at[inside[begin]]
                offsets, members = _ranges(begin, size if whole else 0 * size)
                held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(passage[members].view(np.int64)))
                row = w.row[first]
                ids = batch.column(0).take(pa.array(lo + row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed), pa.array(kind.view(np.int64)), ids, pa.array(first - w.bounds[row], pa.int64()), held], ["seed", "class", "id", "place", "passages"]
                )

    found = docs.mapInArrow(run, "seed bigint, class bigint, id bigint, place bigint, passages array<bigint>")
    return found if whole else found.drop("seed", "passages")


def classes(found: DataFrame) -> DataFrame:
    """(seed, class, n, id, place, passages) of pieces: how many there are of a class, and the first of them."""
    counted = found.groupBy("seed", "class").agg(F.count("*").alias("n"), F.min(F.struct("id", "place", "passages")).alias("first"))
    return counted.select("seed", "class", "n", "first.*")


VERDICT = "class bigint, first_id bigint, first_place bigint, low bigint, high bigint, late_low bigint, late_high bigint"


def _judged(kind, n, ids, place, offsets, passages) -> pa.RecordBatch:
    """Verdicts on the classes of whole groups: the outermost passages that occur again, and those with an earlier occurrence elsewhere."""
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(kind)), size)
    ahead = np.arange(len(owner)) - np.repeat(offsets[:-1], size)
    order = np.lexsort((place[owner] + ahead, ids[owner], passages))
    new = np.flatnonzero(np.append(True, passages[order][1:] != passages[order][:-1])) if len(order) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    owner, ahead = owner[order], ahead[order]
    again = (np.add.reduceat(n[owner], new) if len(new) else n[:0])[group] > 1
    first = new[group]
    late = again & ((ids[owner] != ids[owner[first]]) | (place[owner] + ahead != place[owner[first]] + ahead[first]))
    limits = []
    for chosen in (again, late):
        low, high = np.full(len(kind), WINDOW), np.full(len(kind), -1)
        np.minimum.at(low, owner[chosen], ahead[chosen])
        np.maximum.at(high, owner[chosen], ahead[chosen])
        limits += [low, high]
    some = limits[1] >= 0
    none = limits[3][some] < 0
    columns = [pa.array(c[some], pa.int64()) for c in (kind, ids, place, *limits[:2])] + [pa.array(c[some], pa.int64(), mask=none) for c in limits[2:]]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in VERDICT.split(", ")])


def judge(grouped: DataFrame) -> DataFrame:
    """Verdicts on classes that lie sorted by seed, each seed in one partition."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            seed = batch.column(0).to_numpy()
            # rows of the last seed wait for the next batch
            last = rows.num_rows - batch.num_rows + int(np.searchsorted(seed, seed[-1])) if seed[0] != seed[-1] else None
            if last is None:
                seed = rows.column(0).to_numpy()
                last = int(np.searchsorted(seed, seed[-1]))
            if last:
                yield of(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield of(held)

    def of(rows: pa.Table) -> pa.RecordBatch:
        kind, n, ids, place = (rows.column(c).to_numpy() for c in ("class", "n", "id", "place"))
        lists = rows.column("passages").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        return _judged(kind, n, ids, place, offsets, lists.flatten().to_numpy())

    return grouped.select("seed", "class", "n", "id", "place", "passages").mapInArrow(run, VERDICT)


def judge_heavy(found: DataFrame) -> DataFrame:
    """Verdicts on classes of any number for a seed: one row for each class and passage, and Spark's aggregation."""
    found = checkpoint(found)
    each = found.select("class", "n", "id", F.col("place").alias("first_place"), F.posexplode("passages").alias("ahead", "passage")).withColumn("place", F.col("first_place") + F.col("ahead"))
    again = each.groupBy("passage").agg(F.sum("n").alias("total"), F.min(F.struct("id", "place")).alias("first")).where("total > 1").drop("total")
    late = F.when(F.struct("id", "place") != F.col("first"), F.col("ahead"))
    limits = [f.cast("bigint") for f in (F.min("ahead"), F.max("ahead"), F.min(late), F.max(late))]
    names = ["low", "high", "late_low", "late_high"]
    judged = each.join(again, "passage").groupBy("class", "id", "first_place").agg(*[f.alias(c) for f, c in zip(limits, names, strict=True)])
    return judged.select("class", F.col("id").alias("first_id"), "first_place", *names)


def marks(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, start, end, removed) of pieces (class, id, place); the passages between the outermost ones of a piece are covered by these."""
    both = found.join(verdicts, "class")
    own = (F.col("id") == F.col("first_id")) & (F.col("place") == F.col("first_place"))
    low, high = F.when(own, F.col("late_low")).otherwise(F.col("low")), F.when(own, F.col("late_high")).otherwise(F.col("high"))
    span = lambda a, b, removed: F.struct((F.col("place") + a).alias("start"), (F.col("place") + b + LEAST_WORDS).alias("end"), F.lit(removed).alias("removed"))
    spans = F.array(span(F.col("low"), F.col("high"), False), span(low, high, True))
    return both.select("id", F.explode(spans).alias("x")).select("id", "x.*").where("start IS NOT NULL")


def merged_spans(marks: DataFrame) -> DataFrame:
    """(id, removed, start_word, end_word) of the unions of marks (id, start, end, removed)."""
    kind = Window.partitionBy("id", "removed").orderBy("start", "end")
    fresh = F.coalesce((F.col("start") > F.max("end").over(kind.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    islands = marks.select("id", "removed", "start", "end", fresh.alias("fresh"))
    number = F.sum("fresh").over(kind.rowsBetween(Window.unboundedPreceding, 0))
    islands = islands.select("id", "removed", "start", "end", number.alias("island"))
    return islands.groupBy("id", "removed", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("island")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, removed, n_words): spans of words that occur again somewhere, and, with removed true,
    the parts of them that have an earlier occurrence."""
    spark = df.sparkSession
    docs = only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint")).where("id IS NOT NULL")
    again = checkpoint(seeds(docs).groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"))
    repeated = spark.sparkContext.broadcast(linkage.bloom(again, "seed"))
    # at most MOST_HEAVY seeds, whatever the input
    heavy = max(HEAVY, (again.agg(F.sum("n")).first()[0] or 0) // MOST_HEAVY)
    large = np.sort(np.array([r["seed"] for r in again.where(F.col("n") > heavy).select("seed").collect()], np.int64))
    heavy = spark.sparkContext.broadcast(large)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spans = None
    for of_heavy in (False, True)[: 1 + bool(len(large))]:
        counted = classes(pieces(docs, repeated, heavy, of_heavy, True))
        verdicts = judge_heavy(counted) if of_heavy else judge(counted.repartition(parts, "seed").sortWithinPartitions("seed"))
        some = marks(pieces(docs, repeated, heavy, of_heavy, False), verdicts)
        spans = some if spans is None else spans.unionByName(some)
    spans = merged_spans(spans)
    return spans.select("id", "start_word", "end_word", "removed", (F.col("end_word") - F.col("start_word")).alias("n_words"))
