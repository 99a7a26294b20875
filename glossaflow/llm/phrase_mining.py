"""Collocations: phrases of 2 and 3 words by position bitmaps.

Texts are cut into pieces, and the words of a shard (some texts of one language) are numbered through. A word's bitmap holds
the positions where it stands. Shifting a phrase's bitmap by one word, within pieces, and ANDing it with a word's bitmap gives the bitmap of
the phrase that is longer by this word; its popcount is the phrase's count in the shard, and the sum over shards is its count. Bitmaps
are compressed as containers: sorted positions for a word that stands at less than every 32nd position, else 64 bits to a machine word.
Bitmaps of different words are disjoint, so a list of positions is ANDed with all words' bitmaps at once, by dealing it out by the word at each position.
Phrases grow depth first: a block of first words is followed to its longest phrases before the next block begins.

What is rare everywhere is left out ahead: a first pass adds up hashed words and pairs, and a bitmap of bounded size lets through all that
reach the least count (and a few others, which the exact counts drop later). Nothing else is pruned, so counts are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import linkage
from .common import arrow_rows, only, stored
from .wordhash import LOWER, column_buffers, mix, slices, words

LEAST_COUNT = 10
#: A phrase goes when a longer one that holds it has this percentage of its count.
PERCENT = 50
MOST_PHRASES = 2000
#: Bytes of text to a shard; a longer text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Texts to an Arrow batch that a task reads.
TEXTS = 500
#: Rows to an Arrow batch that a task gives.
ROWS = 1 << 16
#: Positions of the first words that are followed at once.
BLOCK = 1 << 16
#: A bitmap is kept as machine words when more than one position in so many is set.
SPARSE = 32

_GAP = np.zeros(256, bool)
_GAP[[9, 32]] = True
_CUT = np.zeros(256, bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True
_ONE = np.uint64(1)


@dataclass
class Shard:
    """The words of some texts: the code of each, whether it begins a piece, and the words that the codes stand for."""

    code: np.ndarray
    first: np.ndarray
    vocabulary: pa.Array

    def hashes(self, lang: str) -> np.ndarray:
        """A hash of each word of the vocabulary in its language."""
        data, offsets = column_buffers(self.vocabulary)
        salt = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        return mix(words(data, offsets, 0, len(offsets) - 1, fold=False).hash ^ np.uint64(salt))

    def pairs(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose next word is in the same piece, and hashes of these pairs."""
        at = np.flatnonzero(~self.first[1:])
        left, right = value[self.code[at]], value[self.code[at + 1]]
        return at, mix(left * np.uint64(0x9FB21C651E98DF25) + (right ^ (right >> np.uint64(29))), 2)


def _cut(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: the bytes of all words, their lengths, and whether each begins a piece."""
    data, offsets = column_buffers(column)
    for lo, hi in slices(offsets, min(SHARD_BYTES, 1 << 20)):
        base = int(offsets[lo])
        text = LOWER[data[base : int(offsets[hi])]]
        if not len(text):
            continue
        cut = _CUT[text]
        inside = ~(cut | _GAP[text])
        begins = (offsets[lo:hi] - base).astype(np.int64)
        edge = np.zeros(len(text) + 1, bool)
        edge[begins] = True
        before = np.append(False, inside[:-1]) & ~edge[:-1]
        start = np.flatnonzero(inside & ~before)
        if not len(start):
            continue
        after = np.append(inside[1:], False) & ~edge[1:]
        end = np.flatnonzero(inside & ~after) + 1
        marks = np.cumsum(cut, dtype=np.int32)
        row = np.searchsorted(begins, start, "right")
        first = np.ones(len(start), bool)
        first[1:] = (row[1:] != row[:-1]) | (marks[start[1:]] != marks[end[:-1] - 1])
        yield text[inside], (end - start).astype(np.int64), first


def _shards(batches) -> Iterator[tuple[str, Shard]]:
    """Batches of (lang, text) as shards of one language each."""
    held: dict[str, list] = {}
    size = 0

    def close():
        for lang, parts in held.items():
            letters, lengths, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            offsets = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=offsets[1:])
            plain = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
            coded = plain.dictionary_encode()
            yield lang, Shard(coded.indices.to_numpy(zero_copy_only=False), first, coded.dictionary.cast(pa.large_string()))
        held.clear()

    for batch in batches:
        langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            for part in _cut(texts.filter(pc.equal(langs.indices, k))):
                held.setdefault(lang, []).append(part)
                size += len(part[0])
                if size >= SHARD_BYTES:
                    yield from close()
                    size = 0
    yield from close()


def _sums(batches) -> Iterator[pa.RecordBatch]:
    """(key, n): hashed words and pairs of each shard."""
    for lang, shard in _shards(batches):
        value = shard.hashes(lang)
        pairs, n = np.unique(shard.pairs(value)[1], return_counts=True)
        counts = np.bincount(shard.code, minlength=len(value))
        yield from _batches({"key": np.concatenate([value, pairs]).view(np.int64), "n": np.concatenate([counts, n]).astype(np.int64)})


def _batches(columns: dict) -> Iterator[pa.RecordBatch]:
    """Equally long columns as batches of up to ROWS rows."""
    whole = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    for lo in range(0, whole.num_rows, ROWS):
        yield whole.slice(lo, ROWS)


class Bitmaps:
    """The bitmaps of a shard's words that may be frequent, and the phrases that grow from them."""

    def __init__(self, shard: Shard, frequent: np.ndarray, leads: np.ndarray):
        """frequent: by code; leads: by position, whether the pair that begins there may be frequent."""
        self.code, self.leads, self.size = shard.code, leads, len(frequent)
        self.frequent = frequent
        order = np.argsort(shard.code, kind="stable")
        self.order = order[frequent[shard.code[order]]]
        self.bounds = np.searchsorted(shard.code[self.order], np.arange(self.size + 1))
        self.count = np.diff(self.bounds)
        n = len(shard.code)
        self.dense = {int(w): self.packed(self.at(w)) for w in np.flatnonzero(self.count * SPARSE > n)}
        self.inner = self.packed(np.flatnonzero(leads))
        self.rest = self.order[~np.isin(self.code[self.order], list(self.dense))]

    def at(self, w: int) -> np.ndarray:
        return self.order[self.bounds[w] : self.bounds[w + 1]]

    def packed(self, at: np.ndarray) -> np.ndarray:
        flags = np.zeros((len(self.code) // 64 + 1) * 64, bool)
        flags[at] = True
        return np.packbits(flags, bitorder="little").view("<u8")

    @staticmethod
    def unpacked(bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))

    def shifted(self, bits: np.ndarray) -> np.ndarray:
        """One word on, for the positions whose pair may be frequent; these lie in one piece."""
        bits = bits & self.inner
        out = bits << _ONE
        out[1:] |= bits[:-1] >> np.uint64(63)
        return out

    def dealt(self, group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions `at` in ascending groups, shifted and ANDed with the bitmaps of all words: the group before and the word of each
        longer phrase, its popcount, and the phrase (a number) and position of every bit that is left."""
        on = self.leads[at]
        group, at = group[on], at[on] + 1
        key = group * self.size + self.code[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        begin = np.flatnonzero(new)
        return key[begin] // self.size, key[begin] % self.size, np.diff(np.append(begin, len(key))), np.cumsum(new) - 1, at

    def grown(self, parents: list[np.ndarray], group: np.ndarray, at: np.ndarray, depth: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(words of phrases, counts) of all phrases longer than those of the groups, of which parents has the words."""
        before, word, count, group, at = self.dealt(group, at)
        if not len(word):
            return
        longer = [p[before] for p in parents] + [word]
        yield longer, count
        if depth > 1:
            yield from self.grown(longer, group, at, depth - 1)

    def from_dense(self, prefix: tuple[int, ...], bits: np.ndarray, depth: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """The same for one phrase whose bitmap is kept as machine words."""
        on = self.shifted(bits)
        for v, other in self.dense.items():
            both = on & other
            n = int(np.bitwise_count(both).sum())
            if n:
                longer = (*prefix, v)
                yield [np.array([w]) for w in longer], np.array([n])
                if depth > 1 and n * SPARSE > len(self.code):
                    yield from self.from_dense(longer, both, depth - 1)
                elif depth > 1:
                    at = self.unpacked(both)
                    yield from self.grown([np.array([w]) for w in longer], np.zeros(len(at), np.int64), at, depth - 1)
        at = self.rest
        at = at[((on[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE) > 0]  # the sparse words' bitmaps, each ANDed with the shifted one
        code = self.code[at]
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        word, count = code[begin], np.diff(np.append(begin, len(code)))
        longer = [np.full(len(word), w) for w in prefix] + [word]
        if len(word):
            yield longer, count
            if depth > 1:
                yield from self.grown(longer, np.repeat(np.arange(len(word)), count), at, depth - 1)

    def phrases(self, depth: int = 3) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(words of phrases, counts), from one word to `depth` words."""
        present = np.flatnonzero(self.count)
        yield [present], self.count[present]
        for w, bits in self.dense.items():
            yield from self.from_dense((w,), bits, depth - 1)
        ends = np.searchsorted(self.code[self.rest], np.arange(self.size), "right")  # block ends fall between words
        lo = 0
        while lo < len(self.rest):
            hi = int(ends[self.code[self.rest[min(lo + BLOCK, len(self.rest)) - 1]]])
            at = self.rest[lo:hi]
            yield from self.grown([np.arange(self.size)], self.code[at].astype(np.int64), at, depth - 1)
            lo = hi


def _mined(bitmap) -> callable:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches):
            n, value = len(shard.code), shard.hashes(lang)
            yield from _batches({"lang": [lang], "k": np.zeros(1, np.int32), "phrase": [""], "n": np.array([n], np.int64)})
            frequent = linkage.let_through(bitmap.value, value)
            at, pair = shard.pairs(value)
            held = frequent[shard.code[at]] & frequent[shard.code[at + 1]]
            at, pair = at[held], pair[held]
            leads = np.zeros(n, bool)
            leads[at[linkage.let_through(bitmap.value, pair)]] = True
            for phrase, count in Bitmaps(shard, frequent, leads).phrases():
                for lo in range(0, len(count), ROWS):
                    names = [shard.vocabulary.take(pa.array(w[lo : lo + ROWS])) for w in phrase]
                    joined = pc.binary_join_element_wise(*names, pa.scalar(" ", pa.large_string())) if len(names) > 1 else names[0]
                    n = count[lo : lo + ROWS].astype(np.int64)
                    yield from _batches({"lang": pa.repeat(lang, len(n)), "k": np.full(len(n), len(phrase), np.int32), "phrase": joined.cast(pa.string()), "n": n})

    return run


def counted(df: DataFrame, least: int = LEAST_COUNT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, k, phrase, n): how often each phrase of k = 1 to 3 words stands in the texts of a language, from `least` on; with k = 0 the
    number of all words. A null text has no words, a null language is `und`; repeated rows count each time."""
    texts = only(df, lang=lang_col, text=text_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    # words and pairs that fall together by their hash only add to each other, so none that reaches `least` is lost
    keys = texts.mapInArrow(_sums, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    with arrow_rows(df.sparkSession, TEXTS):
        keys = stored(keys)
    bitmap = df.sparkSession.sparkContext.broadcast(linkage.bloom(keys, "key"))  # 32 MB at most
    found = texts.mapInArrow(_mined(bitmap), "lang string, k int, phrase string, n bigint")
    found = found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0))
    with arrow_rows(df.sparkSession, TEXTS):
        return stored(found)


def _parts(lang_phrase: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, left, right): the cuts of each candidate."""
    w = F.split("phrase", " ")
    both = lambda k, size: F.struct(
        F.lit(k).alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("left"), F.array_join(F.slice(w, k + 1, size - k), " ").alias("right")
    )
    cuts = F.when(F.col("k") == 2, F.array(both(1, 2))).otherwise(F.array(both(1, 3), both(2, 3)))
    return lang_phrase.select("lang", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of 2 and 3 words in counts, each with its lowest-scoring cut."""
    of = lambda name, out: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(out))
    cuts = _parts(counts.where("k > 1")).join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    # products of up to 38 digits: a may reach 10^15, l and r 10^19
    score = F.expr("(CAST(1000000BD * CAST(a AS DECIMAL(15,0)) AS DECIMAL(22,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    cuts = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def maximal(counts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase) of the candidates that no longer one holds with `percent` of their count or more."""
    w = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(w, i, 2), " ") for i in (1, 2)])
    held = counts.where("k = 3").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = counts.where("k > 1").join(held, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {percent} * n")
    return kept.select("lang", "phrase")


def collocations(df: DataFrame, least: int = LEAST_COUNT, percent: int = PERCENT, most: int = MOST_PHRASES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and name.

    Pieces end at .,;:!? and line ends, words at spaces and tabs; A-Z count as a-z. Nulls: see counted(). Ties in score and count
    go by the bytes of the phrase, so the order is total. An empty table gives no rows; other columns of df do not matter.
    """
    counts = counted(df, least, text_col, lang_col)
    found = scored(counts).join(maximal(counts, percent), ["lang", "phrase"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first `most` of each bucket of a language, then of the language: no task holds all its phrases
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = found.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= most).drop("bucket")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    every = counts.where("k = 0").select("lang", F.col("n"))
    return ranked.join(every, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
