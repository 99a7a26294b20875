"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded texts.

Folding takes wide and other compatibility forms of letters back to the letters (accents stay, as they tell words apart), puts look-alike letters of other scripts, digits and signs that stand for letters
in their place, lower-cases, and turns everything else into single spaces. The lexicon is learned from at most FIT_ROWS labelled rows
outside the held-out fifth: words and beginnings of words that occur far more often in toxic texts, each weighted by its log odds, as many
as pass LEAST_WEIGHT. Spark counts them; only terms and sums come to the driver. The number of different surroundings is what counts, so
the words of a text with many copies do not enter. A word of the lexicon that clean texts use within a fixed pair of words makes that pair an
exception phrase; a match inside an exception phrase does not count. The sum of the weights, plain and normalised by length, gives the
score by a logistic regression on the same rows.

Nulls and empty texts have no matches. Without labels of both kinds the lexicon is empty and the score is their share, or 0.5 without
labels; an empty table gives an empty result. Very long texts are read whole, in time linear in their length. Repeated rows get equal scores;
of terms with equal counts the shorter, then the lesser one comes first. Other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, held_out, only
from .labelled import training_rows

FIT_ROWS = 8_000
LEAST_TOXIC = 8
LEAST_WEIGHT = 3.0
#: Texts of clean rows that must have a pair of words for it to be an exception.
LEAST_CLEAN = 3
#: Letters that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = dict(zip("аеорсухіјкмнтвѕԁӏαεορτυνικ", "aeopcyxijkmhtbsdlaeoptuvik", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e"}
_FOLD = str.maketrans(LOOKALIKES | SIGNS | {"\u200b": None, "\u200c": None, "\u200d": None, "\u00ad": None})
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words with a space before and after each."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " " + _OTHER.sub(" ", text.lower().translate(_FOLD)).strip() + " "


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(4, min(len(word), 11) + 1)] + [word + " "]


@dataclass
class Lexicon:
    """Weights of terms (a term that ends in a space is a whole word, others are beginnings) and the score's curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(" " + term, (len(term) + 1, weight))
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def signals(self, text: str | None) -> tuple[float, float]:
        """log(1 + total weight) and total weight for each hundred words."""
        folded = fold(text or "")
        if not len(self.automaton()):
            return 0.0, 0.0
        hits, excused = [], []
        for end, (length, weight) in self.automaton().iter(folded):
            if weight is None:
                excused.append((end - length + 1, end))
            else:
                hits.append((end - length + 1, end, weight))
        excused.sort()
        begins, reach = [x for x, _ in excused], list(accumulate((y for _, y in excused), max))
        total = sum(w for a, b, w in hits if not (i := bisect_right(begins, a)) or reach[i - 1] + 1 < b)
        return math.log1p(total), 100 * total / max(folded.count(" ") - 1, 1)

    def score(self, text: str | None) -> float:
        a, b = self.signals(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * a + self.curve[2] * min(b, 50.0) / 10))))


TERMS = "term string, label int, n bigint"
BESIDE = "term string, word string, before string, after string, label int, n bigint"


def _counted(rows: DataFrame, make, schema: str) -> DataFrame:
    """Counts of what make(folded text) gives for each row (text, label), added up within a batch and then by Spark."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update((*key, label) for key in make(fold(text)))
            columns = [pa.array([k[j] for k in total], pa.string()) for j in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k[-1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names)

    return rows.select("text", "label").mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _terms_of(folded: str) -> set[tuple[str]]:
    return {(t,) for w in set(folded.split()) for t in beginnings(w)}


def _beside(likely: frozenset[str]):
    def make(folded: str) -> list[tuple[str, str, str, str]]:
        words = ["", *folded.split(), ""]
        return [(t, w, words[i], words[i + 2]) for i, w in enumerate(words[1:-1]) for t in beginnings(w) if t in likely]

    return make


def likely_terms(rows: DataFrame, n: dict[int, int]) -> dict[str, tuple[int, int, float]]:
    """(toxic texts, clean texts, weight) of the terms of rows (text, label) that tell toxic texts; n: how many texts there are of each label."""
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    both = _counted(rows, _terms_of, TERMS).groupBy("term").agg(of(1).alias("toxic"), of(0).alias("clean")).where(F.col("toxic") >= LEAST_TOXIC)
    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    found = {r["term"]: (r["toxic"], r["clean"], r["weight"]) for r in both.withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT).collect()}
    # a beginning gives way to a longer one that almost all its toxic texts have, but to the whole word only for cause
    narrower = lambda e, b: found[e][0] >= 0.95 * found[b][0] and (not e.endswith(" ") or found[e][1] < found[b][1])
    loose = {e[:k] for e in found for k in range(4, len(e)) if e[:k] in found and narrower(e, e[:k])}
    return {t: v for t, v in found.items() if t not in loose}


def learn(rows: DataFrame, exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """A lexicon from rows (text, label) without repeats."""
    n = {0: 0, 1: 0} | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n[0] or not n[1]:
        share = 0.5 if not sum(n.values()) else min(max(n[1] / sum(n.values()), 1e-3), 1 - 1e-3)
        return Lexicon(curve=(math.log(share / (1 - share)), 0.0, 0.0))
    likely = likely_terms(rows, n)
    beside = checkpoint(_counted(rows, _beside(frozenset(likely)), BESIDE))
    sides = F.countDistinct("before", "after")
    around = {r["term"] for r in beside.where("label = 1").groupBy("term").agg(sides.alias("sides")).where(F.col("sides") >= LEAST_TOXIC).collect()}
    kept: dict[str, float] = {}
    for t in sorted(around, key=lambda t: (len(t), t)):
        if not any(t[:k] in kept for k in range(4, len(t))):
            kept[t] = likely[t][2]
    pairs = beside.where(F.col("term").isin(*kept)).select("term", "label", "n", F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("pair"))
    pairs = pairs.groupBy("term", "pair").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.max("label").alias("label"))
    found = {r["pair"].strip() for r in pairs.where((F.col("clean") >= LEAST_CLEAN) & (F.col("label") == 0)).collect()}
    lexicon = Lexicon(kept, exceptions | frozenset(found))
    lexicon.curve = _fitted(lexicon, rows)
    return lexicon


def _fitted(lexicon: Lexicon, rows: DataFrame) -> tuple[float, float, float]:
    """The logistic curve over the two signals of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            found = [shared.value.signals(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64()), batch.column(1)], ["a", "b", "label"])

    seen = sorted(rows.select("text", "label").mapInArrow(run, "a double, b double, label int").collect())  # three numbers for each of FIT_ROWS
    x = np.array([(1.0, a, min(b, 50.0) / 10) for a, b, _ in seen])
    y = np.array([label for *_, label in seen], float)
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> Lexicon:
    """The lexicon of at most `most` labelled rows that are not held out; texts stay in Spark's shared folder."""
    return learn(checkpoint(training_rows(docs, labels, label, most).select("text", "label").distinct()))


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            found = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return only(df, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
