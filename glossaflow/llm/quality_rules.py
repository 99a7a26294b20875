"""Quality rules with thresholds that adapt to each language and source.

Counts are taken over every whole text. Four rates (thousandths) go into quantile sketches: counts of buckets that grow
with the value (an eighth of a power of two each), so sketches of any two sets of rows merge by adding the counts, and
a third of all rows under one key is added up on the map side. From the sketch of a (lang, source) come its median and
tenth percentile; a document is rejected where a rate lies above
median + SPREAD * max(median - tenth percentile, least spread). This limit of a (lang, source) of n documents is blended with that of its
language, as if from PRIOR more documents, and a language's in the same way with that of all documents, so small groups lean on wider
ones and nothing changes at any one size.

Nulls: a null text has no words and fails the base rule; null languages and sources are groups like any other. Repeated
rows count as often as they occur. An empty table gives an empty result. Other columns of the input are passed on by
add_counts() unless they have a name of its own columns, which are replaced. Very long texts are read whole; a rate that equals its limit passes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, only
from .wordhash import column_buffers, mix, slices, window_hashes, words

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_lines")
#: Rate, of which count, against which count, least spread in thousandths.
RATES = (
    ("symbol_rate", "n_symbols", "word_chars", 5),
    ("upper_rate", "n_upper", "word_chars", 20),
    ("repeat_rate", "n_repeat_words", "n_words", 80),
    ("bang_rate", "n_bangs", "n_words", 10),
)
SPREAD = 6
PRIOR = 200
MIN_WORDS = 50


def _later_equal(row: np.ndarray, value: np.ndarray, earlier: bool) -> np.ndarray:
    """Which entries equal an earlier entry of the same row (or, if not earlier, any other one)."""
    order = np.lexsort((value, row))
    same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.zeros(len(row), bool)
    out[order[1:][same]] = True
    if not earlier:
        out[order[:-1][same]] = True
    return out


def _counts(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> dict[str, np.ndarray]:
    w, rows = words(data, offsets, lo, hi, fold=False), hi - lo
    text = w.bytes
    begins = offsets[lo : hi + 1] - offsets[lo]

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(text) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[begins[1:]] - total[begins[:-1]]

    out = {"n_words": np.diff(w.bounds)}
    inside = np.zeros(len(text) + 1, np.int8)
    inside[w.start] += 1
    np.subtract.at(inside, w.end, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    out["word_chars"] = per_row(inside & ((text & 0xC0) != 0x80))
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    out["n_symbols"] = per_row(table[text])
    out["n_upper"] = per_row((text >= 65) & (text <= 90))
    out["n_bangs"] = per_row(text == 33)
    # lines: between line feeds and the bounds of rows
    feeds = np.flatnonzero(text == 10)
    start = np.concatenate([begins[:-1], feeds + 1])
    row = np.concatenate([np.arange(rows), np.searchsorted(begins, feeds, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.where(last, begins[row + 1], np.append(start[1:], 0) - 1)
    first = np.searchsorted(w.start, start, "left")
    some = np.searchsorted(w.start, end, "left") > first
    from . import wordhash

    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * wordhash._powers[: len(text)], out=total[1:])
    value = mix((total[end] - total[start]) * wordhash._inverse_powers[start], 3) + mix((end - start).astype(np.uint64), 4)
    row, value = row[some], value[some]
    out["n_lines"] = np.bincount(row, minlength=rows)
    out["n_dup_lines"] = np.bincount(row[_later_equal(row, value, True)], minlength=rows)
    at, value = window_hashes(w, 3)
    found = at[_later_equal(w.row[at], value, False)]
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[found + k] = True
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=rows)
    return out


def add_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df with the columns of COUNTS."""
    kept = [f for f in df.schema.fields if f.name not in COUNTS]
    at = [f.name for f in kept].index(text_col)

    def run(batches):
        for batch in batches:
            data, offsets = column_buffers(batch.column(at))
            parts = [_counts(data, offsets, lo, hi) for lo, hi in slices(offsets)]
            columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *COUNTS])

    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return df.select(*[f.name for f in kept]).mapInArrow(run, schema)


def rate(of: str, against: str) -> Column:
    return F.expr(f"{of} * 1000 div greatest({against}, 1)")


def bucket(value: Column) -> Column:
    """Values up to 15 have a bucket each; beyond, every power of two has eight."""
    power = F.length(F.bin(value)).cast("bigint") - 4
    return F.when(value < 16, value).otherwise(power * 8 + F.floor(value / F.pow(F.lit(2.0), power)).cast("bigint"))


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    power = F.floor((b - 8) / 8).cast("bigint")
    return F.when(b < 16, b).otherwise(((b - power * 8) * F.pow(F.lit(2.0), power)).cast("bigint"))


def sketches(counted: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(lang, source, level, rate, bucket, n): level 2 for (lang, source), 1 for lang, 0 for all rows."""
    lang, source = groups
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), bucket(rate(a, b)).alias("bucket")) for name, a, b, _ in RATES]))
    base = (
        counted.select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("x"))
        .select("lang", "source", "x.*")
        .groupBy("lang", "source", "rate", "bucket")
        .agg(F.count("*").alias("n"))
    )
    return merge(base)


def merge(base: DataFrame) -> DataFrame:
    """Sketches of (lang, source) merged to languages and to all rows."""
    null = F.lit(None).cast("string")
    levels = [
        base.withColumn("level", F.lit(2)),
        base.withColumn("source", null).withColumn("level", F.lit(1)),
        base.withColumn("source", null).withColumn("lang", null).withColumn("level", F.lit(0)),
    ]
    return reduce(DataFrame.unionByName, levels).groupBy("level", "lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))


def thresholds(counted: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(lang, source, symbol_rate, upper_rate, ...): the highest rates that pass; a row for each (lang, source)."""
    from pyspark.sql import Window

    key = ["level", "lang", "source", "rate"]
    of = Window.partitionBy(*key)
    up_to = of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = sketches(counted, groups).select(*key, "bucket", F.sum("n").over(of).alias("all"), F.sum("n").over(up_to).alias("below"))

    def quantile(percent: int) -> Column:
        return bucket_floor(F.min(F.when(F.col("below") * 100 >= F.col("all") * percent, F.col("bucket"))))

    least = F.create_map(*[x for name, _, _, s in RATES for x in (F.lit(name), F.lit(s).cast("bigint"))])
    limits = placed.groupBy(*key).agg(F.max("all").alias("all"), quantile(50).alias("mid"), quantile(10).alias("low"))
    limits = limits.select(*key, "all", (F.col("mid") + SPREAD * F.greatest(F.col("mid") - F.col("low"), least[F.col("rate")])).alias("most"))
    wide = limits.groupBy("level", "lang", "source").agg(F.max("all").alias("all"), *[F.max(F.when(F.col("rate") == r[0], F.col("most"))).alias(r[0]) for r in RATES])
    names = [r[0] for r in RATES]
    level = lambda n: wide.where(F.col("level") == n).select("lang", "source", F.struct("all", *names).alias(f"l{n}"))
    by_lang, everything = level(1).select(F.col("lang").alias("lang1"), "l1"), level(0).select("l0")
    joined = level(2).join(by_lang, F.col("lang").eqNullSafe(F.col("lang1")), "left").join(everything)  # one row
    blend = lambda own, of, wider: f"({own} * {of} + {PRIOR} * {wider}) div ({of} + {PRIOR})"
    by_language = {n: blend(f"l1.{n}", "l1.all", f"l0.{n}") for n in names}
    return joined.select("lang", "source", *[F.expr(blend(f"l2.{n}", "l2.all", f"({by_language[n]})")).alias(f"most_{n}") for n in names])


def small_enough(limits: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Broadcast the thresholds only when counted to be few; beyond that Spark picks a shuffled join."""
    return F.broadcast(limits) if limits.limit(most_rows + 1).count() <= most_rows else limits


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(counted: DataFrame, limits: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """counted with base_failed and kept; limits as thresholds() gives them."""
    lang, source = groups
    names = [f"most_{r[0]}" for r in RATES]
    held = fresh(counted, "limits")
    limits = limits.select(F.struct("lang", "source", *names).alias(held))
    on = counted[lang].eqNullSafe(limits[held]["lang"]) & counted[source].eqNullSafe(limits[held]["source"])
    within = reduce(lambda a, b: a & b, [rate(a, b) <= F.col(f"{held}.most_{n}") for n, a, b, _ in RATES])
    return (
        counted.join(limits, on, "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))
        .drop(held)
    )


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, counts, base_failed, kept) of each row."""
    counted = checkpoint(add_counts(only(df, id=id_col, lang=lang_col, source=source_col, text=text_col)).drop("text"))
    return judge(counted, small_enough(checkpoint(thresholds(counted))))


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df that quality() would keep, with df's columns."""
    counted = add_counts(only(df, lang=lang_col, source=source_col, text=text_col)).drop("text")
    limits = small_enough(checkpoint(thresholds(counted)))
    # df's columns go through as one, so none of them clashes with the counts
    whole = df.select(df[text_col].alias("text"), df[lang_col].alias("lang"), df[source_col].alias("source"), F.struct("*").alias("own"))
    return judge(add_counts(whole), limits).where("kept").select("own.*")
