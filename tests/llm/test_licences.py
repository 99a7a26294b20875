import random
import re

import numpy as np
import pyarrow as pa

from glossaflow.llm import license_scan as ls

from .conftest import words


def plain(text, scanner):
    """The row of a text by comparing every place with every notice."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    phrases = [(p.split(), label) for p, label in scanner.phrases]
    places = [(i, label) for p, label in phrases for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    notices = [ls.split(t) for *_, t in scanner.templates]
    every = {tuple(s[i:j]) for s in notices + [p for p, _ in phrases] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    length = []
    for i in range(len(ws)):
        n = length[-1] + 1 if length else 1
        while n and tuple(ws[i + 1 - n : i + 1]) not in every:
            n -= 1
        length.append(n)
    chains = []
    for k, s in enumerate(notices):
        anchors = []
        for i, n in enumerate(length):
            if n >= ls.MATCH and (i + 1 == len(ws) or length[i + 1] <= n):
                anchors += [(i + 1, t + n, n) for t in range(len(s) - n + 1) if s[t : t + n] == ws[i + 1 - n : i + 1]]
        anchors.sort()
        best, back = [], []
        for j, (e, te, n) in enumerate(anchors):
            options = [(n, 1, -1)]
            for i in range(j):
                pe, pte, _ = anchors[i]
                fresh = min(n, e - pe, te - pte)
                if fresh > 0 and e - n - pe <= ls.GAP and te - n - pte <= ls.GAP:
                    options.append((best[i] + fresh, -i, i))
            top = max(options, key=lambda o: o[:2])
            best.append(top[0])
            back.append(top[2])
        used = set()
        for j in sorted(range(len(anchors)), key=lambda x: (-best[x], x)):
            i, first = j, len(ws)
            if j in used:
                continue
            while i >= 0 and i not in used:
                used.add(i)
                first = min(first, anchors[i][0] - anchors[i][2])
                i = back[i]
            covered = best[j] - (best[i] if i >= 0 else 0)
            chains.append((covered, covered / len(s), scanner.templates[k][1], first, anchors[j][0] - 1, scanner.templates[k][0], len(s)))
    kept = []
    for c in sorted(chains, key=lambda c: (-c[0], -c[1], c[2], c[3])):
        if c[0] >= min(ls.LEAST_WORDS, c[6]) and c[1] * 100 >= ls.PERCENT and all(c[4] < o[3] or o[4] < c[3] for o in kept):
            kept.append(c)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {c[5] for c in kept})), max((c[1] for c in chains), default=0.0))


def mixed_texts():
    rng = random.Random(5)
    out = [None, "", " ", "MIT License", "the mit, LICENSE apache-license x general public license general public license", "mit license " * 40, "İmit license", "mit\x00license"]
    for label, name, text in ls.TEMPLATES:
        ws = text.split()
        out += [text, f"{words(30, 1)} {text} {words(20, 2)}", " ".join(ws[: len(ws) // 2]), " ".join(w for w in ws if rng.random() < 0.9), f"{text}{text} {text[40:]}"]
        out.append(" ".join(w if rng.random() < 0.93 else f"x{rng.randint(0, 9)}" for w in ws))
    vocabulary = sorted({w for *_, t in ls.TEMPLATES for w in ls.split(t)})
    return out + [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(5)]


def test_rows_equal_plain_search(spark):
    scanner = ls.Scanner()
    texts = mixed_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").repartition(3)
    found = {r["id"]: tuple(r)[1:] for r in ls.licences(df).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert found[i] == plain(text, scanner), text
    labels = {r["label"] for r in ls.spans(df).collect()}
    assert labels == {t[0] for t in ls.TEMPLATES}


def test_small_notices_with_many_repeats():
    rng = random.Random(6)
    pick = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for _ in range(60):
        scanner = ls.Scanner([(f"l{i}", f"n{i}", pick(rng.randint(1, 14))) for i in range(3)], [("a b", "ab"), ("c", "c"), ("b a b", "bab")])
        texts = [pick(rng.randint(0, 40)) for _ in range(6)]
        for row, n, places, found, score in scanner.scan(pa.array(texts)):
            base = plain(texts[row], scanner)
            assert (n, score) == (base[0], base[-1])
            # single words are no pairs, so only phrases of two words and more are looked for
            assert sum(k != 1 for _, k in places) == base[1] - texts[row].split().count("c")


def test_matching_statistics_equal_plain_ones():
    rng = random.Random(7)
    for _ in range(100):
        sequences = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(3)]
        a = ls.Automaton(sequences)
        text = [rng.randint(0, 3) for _ in range(30)]
        inside = lambda run: [(k, j) for k, s in enumerate(sequences) for j in range(len(run), len(s) + 1) if s[j - len(run) : j] == run]
        for i, (v, n) in enumerate(a.statistics(text)):
            assert n == max(m for m in range(i + 2) if m == 0 or inside(text[i + 1 - m : i + 1]))
            if n:
                assert a.occurrences(v) == inside(text[i + 1 - n : i + 1])


def test_awkward_rows(spark, awkward, empty):
    scanner = ls.Scanner()
    rows = sorted((str(tuple(r)) for r in ls.licences(awkward).collect()))
    assert rows == sorted(str((r["doc_id"], *plain(r["text"] if len(r["text"] or "") < 9000 else "", scanner))) if len(r["text"] or "") < 9000 else str((r["doc_id"], *_long(r["text"]))) for r in awkward.select("doc_id", "text").collect())
    assert ls.licences(empty).count() == 0 and ls.spans(empty).count() == 0


def _long(text):
    scanner = ls.Scanner()
    (_, n, places, found, score) = next(scanner.scan(pa.array([text])))
    assert n == len(text.split()) and not places and not found and np.isfinite(score)
    return n, 0, None, None, "", "", score


def test_notices_of_one_family_are_told_apart(spark):
    texts = {name: text for _, name, text in ls.TEMPLATES}
    df = spark.createDataFrame([(i, texts[n]) for i, n in enumerate(("gpl-notice", "lgpl-notice", "agpl-notice", "cc-by-nc-line", "apache-line"))], "doc_id INT, text STRING")
    found = {r["id"]: r["labels"] for r in ls.licences(df).collect()}
    assert [found[i] for i in range(5)] == ["gpl", "gpl,lgpl", "agpl,gpl", "cc-by-nc", "apache"]
