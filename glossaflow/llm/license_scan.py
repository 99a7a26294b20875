"""Licence notices in texts, by a generalised suffix automaton of the notices' words.

The automaton knows every run of words that stands in a notice. A text streams through it word by word; the state and the length of the
longest run that ends at each word are its matching statistics. Runs that cannot be carried on and have MATCH words or more are anchors:
each says that words of the text equal words of a notice. Anchors of one notice that follow each other in both are chained, gaps of up
to GAP words in between (names, years, changed words), and a chain that covers enough of its notice is a span. The base phrases are in the
automaton as well: their states, and all states below these by suffix links, tell where they end.

Only stretches whose word pairs all stand in some notice can hold two words of one, so all else is passed over by whole columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only
from .license_templates import PHRASES, TEMPLATES
from .wordhash import Words, column_buffers, slices, words

#: Words of an anchor, words between anchors of a chain, and what a chain must cover to be a span: words, and percent of the notice.
MATCH = 3
GAP = 12
LEAST_WORDS = 5
PERCENT = 75

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text: str) -> list[str]:
    """Words of a notice: runs of ASCII letters and digits and of anything beyond ASCII, A-Z as a-z."""
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """The smallest automaton that accepts all runs of words of some sequences; its states are sets of ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extended(last, word)
                self.ends[last].append((k, i + 1))
        self.below: list[list[int]] = [[] for _ in self.link]
        for v, up in enumerate(self.link):
            if up >= 0:
                self.below[up].append(v)
        self._found: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int, link: int, then: dict[int, int]) -> int:
        self.next.append(then)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of the runs of q that are no longer than p's and the word."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def occurrences(self, v: int) -> list[tuple[int, int]]:
        """(sequence, end) of all places where the runs of a state stand."""
        if v not in self._found:
            found, stack = [], [v]
            while stack:
                x = stack.pop()
                found += self.ends[x]
                stack += self.below[x]
            self._found[v] = sorted(found)
        return self._found[v]

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest run that ends at each word."""
        v = length = 0
        for word in sequence:
            while v and word not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            if word in self.next[v]:
                v = self.next[v][word]
                length += 1
            yield v, length


@dataclass(frozen=True)
class Span:
    """A notice in a text: its words first to last (from 0) hold `covered` of its `size` words, in chained runs."""

    label: str
    name: str
    first: int
    last: int
    covered: int
    size: int


class Scanner:
    """Notices, and phrases of two words or more, ready to be looked for."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates, self.phrases = tuple(templates), tuple(phrases)
        sequences = [split(t) for *_, t in self.templates] + [split(p) for p, _ in self.phrases]
        self.vocabulary = sorted({w for s in sequences for w in s})
        place = {w: i for i, w in enumerate(self.vocabulary)}
        self.sequences = [[place[w] for w in s] for s in sequences]
        self.automaton = Automaton(self.sequences)
        n = len(self.vocabulary)
        self.pairs = np.zeros((n + 1, n + 1), bool)  # by codes; n is any other word
        for s in self.sequences:
            self.pairs[s[:-1], s[1:]] = True
        data, offsets = column_buffers(pa.array(self.vocabulary, pa.large_string()))
        value = words(data, offsets, 0, n, letters=LETTERS).hash if n else np.zeros(0, np.uint64)
        self.by_hash = np.argsort(value)
        self.hashes = value[self.by_hash]

    @cached_property
    def ending(self) -> list[tuple[tuple[int, int], ...]]:
        """By state: (phrase, words) of the phrases among the suffixes of its runs."""
        a = self.automaton
        told: list[tuple] = [()] * len(a.link)
        own: dict[int, list[tuple[int, int]]] = {}
        for k in range(len(self.phrases)):
            sequence = self.sequences[len(self.templates) + k]
            if sequence:
                v = 0
                for word in sequence:
                    v = a.next[v][word]
                own.setdefault(v, []).append((k, len(sequence)))
        for v in sorted(range(len(a.link)), key=a.length.__getitem__):
            told[v] = (told[a.link[v]] if v else ()) + tuple(own.get(v, ()))
        return told

    def runs(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end) of stretches whose pairs of words all stand in notices, and the codes of all words."""
        n = len(self.vocabulary)
        spot = np.minimum(np.searchsorted(self.hashes, w.hash), max(n - 1, 0))
        code = np.where(self.hashes[spot] == w.hash, self.by_hash[spot], n) if n else np.full(len(w), n)
        good = self.pairs[code[:-1], code[1:]] & (w.row[:-1] == w.row[1:])
        edge = np.diff(np.concatenate([[False], good, [False]]).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1, code

    def look(self, codes: list[int], at: int, anchors: list, places: list) -> None:
        """The anchors (text begin, notice, notice begin, words) and phrase places (begin, phrase) of a stretch that begins at word `at`."""
        a, ending = self.automaton, self.ending
        seen = list(a.statistics(codes))
        for i, (v, length) in enumerate(seen):
            places += [(at + i + 1 - size, k) for k, size in ending[v] if size <= length]
            if length >= MATCH and (i + 1 == len(seen) or seen[i + 1][1] <= length):
                anchors += [(at + i + 1 - length, k, end - length, length) for k, end in a.occurrences(v) if k < len(self.templates)]

    def chains(self, anchors: list[tuple[int, int, int, int]]) -> list[Span]:
        """The anchors of one text as chains, each anchor in one of them, whatever they cover."""
        found = []
        for k in sorted({x[1] for x in anchors}):
            mine = sorted((s + n, t + n, n) for s, j, t, n in anchors if j == k)
            best, back, low = [], [], 0
            longest = max(n for *_, n in mine)
            for j, (e, te, n) in enumerate(mine):
                while mine[low][0] < e - longest - GAP:
                    low += 1
                score, before = n, -1
                for i in range(low, j):
                    pe, pte, _ = mine[i]
                    fresh = min(n, e - pe, te - pte)  # what the anchor adds behind the other one
                    if fresh > 0 and e - n - pe <= GAP and te - n - pte <= GAP and best[i] + fresh > score:
                        score, before = best[i] + fresh, i
                best.append(score)
                back.append(before)
            used = [False] * len(mine)
            for j in sorted(range(len(mine)), key=lambda x: (-best[x], x)):
                if used[j]:
                    continue
                i, first = j, mine[j][0] - mine[j][2]
                while i >= 0 and not used[i]:
                    used[i] = True
                    first = min(first, mine[i][0] - mine[i][2])
                    i = back[i]
                covered = best[j] - (best[i] if i >= 0 else 0)
                label, name, _ = self.templates[k]
                found.append(Span(label, name, first, mine[j][0] - 1, covered, len(self.sequences[k])))
        return found

    @staticmethod
    def chosen(chains: list[Span]) -> list[Span]:
        """Chains that cover enough; of chains that share words of the text, those that cover most."""
        kept: list[Span] = []  # in the order of the text; none overlaps another
        for s in sorted(chains, key=lambda s: (-s.covered, -s.covered / s.size, s.name, s.first)):
            if s.covered >= min(LEAST_WORDS, s.size) and 100 * s.covered >= PERCENT * s.size:
                i = bisect_left(kept, s.first, key=lambda o: o.first)
                if not (i and kept[i - 1].last >= s.first) and not (i < len(kept) and kept[i].first <= s.last):
                    kept.insert(i, s)
        return kept

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int]], list[Span], float]]:
        """(row, words, phrase places, spans, score) of each text; the score is the greatest share of a notice that a chain covers."""
        data, offsets = column_buffers(column)
        for lo, hi in slices(offsets):
            w = words(data, offsets, lo, hi, letters=LETTERS)
            anchors: dict[int, list] = {}
            places: dict[int, list] = {}
            if len(w):
                begin, end, code = self.runs(w)
                for b, e, row in zip(begin.tolist(), end.tolist(), w.row[begin].tolist(), strict=True):
                    self.look(code[b:e].tolist(), b - int(w.bounds[row]), anchors.setdefault(row, []), places.setdefault(row, []))
            count = np.diff(w.bounds)
            for row in range(hi - lo):
                chains = self.chains(anchors[row]) if anchors.get(row) else []
                yield lo + row, int(count[row]), places.get(row, []), self.chosen(chains), max((s.covered / s.size for s in chains), default=0.0)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(id, label, name, first_word, last_word, covered, size) of the notices in each text; texts without any have no row."""
    source = only(df, id=id_col, text=text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, ())
        for batch in batches:
            ids = batch.column(0)
            rows = [(row, s) for row, _, _, found, _ in scanner.scan(batch.column(1)) for s in found]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r for r, _ in rows], pa.int64()))] + [pa.array([getattr(s, c) for _, s in rows], t) for c, t in (("label", pa.string()), ("name", pa.string()), *((c, pa.int64()) for c in ("first", "last", "covered", "size")))],
                ["id", "label", "name", "first_word", "last_word", "covered", "size"],
            )

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, label string, name string, first_word bigint, last_word bigint, covered bigint, size bigint")


def licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row for each row of df.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and largest word where one begins (null if
    none). labels has those of the phrases and of the spans. A null text is an empty one: no words, no labels, score 0. Repeated rows
    and rows with a null id have a row each; other columns do not matter.
    """
    source = only(df, id=id_col, text=text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            rows = []
            for _, n, places, found, score in scanner.scan(batch.column(1)):
                base = {phrases[k][1] for _, k in places}
                starts = [s for s, _ in places]
                rows.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s.label for s in found})), score))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", *_SCAN])

    kinds = ["bigint"] * 4 + ["string"] * 2 + ["double"]
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, " + ", ".join(f"{c} {t}" for c, t in zip(_SCAN, kinds, strict=True)))


_SCAN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
