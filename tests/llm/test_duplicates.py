import random
import re
from collections import Counter, defaultdict

import pytest

from glossaflow.llm import jaccard_join, linkage, paragraph_dedup, suffix_dedup

from .conftest import COLUMNS, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def corpus(n_groups=6, copies=40, seed=3):
    """Groups of copies with more and more words changed, exact copies, a shared passage, and texts of their own."""
    rng = random.Random(seed)
    rows, doc = [], 0
    shared = words(60, 999)
    for g in range(n_groups):
        base = words(90, g).split()
        for c in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            cut = rng.randrange(len(w))
            lines = [" ".join(w[:cut]), " ".join(w[cut:])] if g % 2 else [" ".join(w)]
            rows.append((doc, "\n".join(lines), "en", "s", 1))
            doc += 1
    for i in range(60):
        rows.append((doc, words(80, 500 + i) + " " + shared, "en", "s", 1))
        doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [24, 3])
def test_components_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(linkage, "SMALL_LIST", small)
    rows = corpus()
    sets = {i: shingles(tokens(t), 4) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * (o := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - o)]
    expected = union_find(links, ids)
    got = {r["id"]: r for r in jaccard_join.similar_components(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(expected.values())) < len(ids)


def test_join_of_awkward_rows(spark, awkward, empty):
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(awkward).collect()}
    by_id = {i: c for i, _, c in got}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[13] == 1
    assert by_id[7] == by_id[8] == 7 and by_id[4] == 4 and by_id[5] == 5 and by_id[6] == 6 and by_id[None] is None
    assert {n for i, n, _ in got if i in (4, 5, 6)} == {0}
    kept = jaccard_join.one_of_each(awkward)
    assert kept.columns == awkward.columns and {2, 3, 8, 13}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert jaccard_join.similar_components(empty).count() == 0


def test_bitmaps_that_let_all_through_change_no_result(spark, monkeypatch, awkward):
    import numpy as np

    docs = spark.createDataFrame([*corpus(), (5, "of an id that comes twice", "en", "s", 1), (None, "null", "en", "s", 1)], COLUMNS).repartition(3)
    expected = sorted(map(str, jaccard_join.one_of_each(docs.where("doc_id <> 5 OR doc_id IS NULL")).collect()))
    twice = {r["doc_id"] for r in jaccard_join.one_of_each(awkward).collect()}
    monkeypatch.setattr(linkage, "bloom", lambda *_, **__: np.full(8192, 255, np.uint8))
    assert sorted(map(str, jaccard_join.one_of_each(docs.where("doc_id <> 5 OR doc_id IS NULL")).collect())) == expected
    assert {r["doc_id"] for r in jaccard_join.one_of_each(awkward).collect()} == twice
    ids = [r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()]
    assert ids.count(5) <= 1 and None in ids


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}


@pytest.mark.parametrize("operator", [jaccard_join.similar_components, paragraph_dedup.near_duplicates])
def test_no_shuffle_files_are_left(spark, operator):
    docs = spark.createDataFrame(corpus(), COLUMNS).repartition(3)
    before = shuffle_files(spark)
    operator(docs)
    assert shuffle_files(spark) <= before


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a BIGINT, b BIGINT")
    got = {r["id"]: r["component"] for r in linkage.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_bitmap_lets_all_ids_through(spark):
    import numpy as np

    bits = linkage.bloom(spark.range(-500, 500))
    assert linkage.let_through(bits, np.arange(-500, 500)).all()
    assert linkage.let_through(bits, np.arange(10**6, 10**6 + 1000)).mean() < 0.1
    full = linkage.bloom(spark.range(100_000), most_bits=1 << 16)  # more than it has room for: it lets more through, and loses nothing
    assert linkage.let_through(full, np.arange(100_000)).all()
    assert not linkage.let_through(linkage.bloom(spark.range(0)), np.arange(1000)).any()


def paragraph_truth(rows):
    """Removals of whole paragraphs by brute force: lines of 30 words, and runs of shorter lines."""
    where, sets = defaultdict(list), {}
    for i, t, *_ in rows:
        lines = [w for w in (tuple(tokens(line)) for line in (t or "").split("\n")) if w]
        place = 0
        while place < len(lines):
            last = place + 1
            while len(lines[place]) < 30 and last < len(lines) and len(lines[last]) < 30:
                last += 1
            w = sum(lines[place:last], ())
            if len(w) >= 30:
                where[w].append((i, place, 0))
                sets[w] = shingles(w, 5)
            place = last
    keys = list(sets)
    links = [(a, b) for a in range(len(keys)) for b in range(a) if 100 * (o := len(sets[keys[a]] & sets[keys[b]])) >= 80 * (len(sets[keys[a]]) + len(sets[keys[b]]) - o)]
    groups = defaultdict(list)
    for n, top in union_find(links, range(len(keys))).items():
        groups[top] += where[keys[n]]
    return {o: (":".join(map(str, min(g))), o != min(g)) for g in groups.values() if len(g) > 1 for o in g}


def paragraphs_found(spark, rows):
    found = paragraph_dedup.near_duplicates(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    return {(r["id"], r["position"], r["start_word"], r["n_words"]): (r["component"], r["removed"]) for r in found}


def test_paragraphs_equal_brute_force(spark):
    rows = corpus(4, 30) + [(900 + i, "\n".join(words(9, 70 + k % 4) for k in range(5)) + "\n" + words(40, 80 + i % 3), "en", "s", 1) for i in range(8)]
    truth = paragraph_truth(rows)
    whole = {(i, p, s): v for (i, p, s, n), v in paragraphs_found(spark, rows).items() if s == 0 and (i, p, s) in truth}
    assert {k for k in truth} == set(whole)
    # a piece may begin at the first word of a paragraph as well; it has a component of its own
    pieces = sum(n == paragraph_dedup.PIECE for *_, n in paragraphs_found(spark, rows))
    assert sum(whole[k] != v for k, v in truth.items()) <= pieces


def test_spliced_passages_are_found_and_others_left_alone(spark):
    rows, held = [], set()
    for p in range(120):  # passages of 51 to 90 words, over lines and within them, each in three texts
        passage = words(51 + p % 40, 2000 + p).split()
        passage = "\n".join([" ".join(passage[:22]), " ".join(passage[22:])]) if p % 3 == 0 else " ".join(passage)
        for c in range(3):
            rows.append((len(rows), words(30 + p % 17 + c, 30_000 + 3 * p + c) + " " + passage + " " + words(25 + c, 60_000 + 3 * p + c), "en", "s", 1))
            held.add(rows[-1][0])
    shared = words(20, 5)  # a common short line, and common stretches of fewer words than a paragraph
    for i in range(150):
        rows.append((len(rows), words(60, 90_000 + i) + "\n" + shared + "\n" + words(45, 95_000 + i) + " " + shared + " x", "en", "s", 1))
    found = paragraphs_found(spark, rows)
    got = {i for i, *_ in found}
    assert len(got & held) >= 0.98 * len(held) and got <= held
    removed = {i for (i, *_), (_, gone) in found.items() if gone}
    assert removed == {i for i in got if i != min(j for j in got if j // 3 == i // 3)}


def test_hot_classes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(paragraph_dedup, "LEAST_HOT", 5)
    line = words(40, 1)
    rows = [(i, words(35, 100 + i) + "\n" + line, "en", "s", 1) for i in range(40)] + [(100 + i, words(40, 2), "en", "s", 1) for i in range(3)]
    got = {(i, p): v for (i, p, s, n), v in paragraphs_found(spark, rows).items() if n == 40}
    assert got == {(i, 1): ("0:1:0", i > 0) for i in range(40)} | {(100 + i, 0): ("100:0:0", i > 0) for i in range(3)}


def test_paragraphs_of_awkward_rows(spark, awkward, empty):
    got = [(r["id"], r["position"], r["removed"]) for r in paragraph_dedup.near_duplicates(awkward).where("n_words > 50").collect()]
    assert {(i, p) for i, p, _ in got} >= {(1, 0), (2, 0), (3, 0), (11, 0), (11, 2)} and {i for i, *_ in got} <= {1, 2, 3, 11, 13}
    assert sum(1 for i, *_ in got if i == 1) == 2  # the repeated row
    assert paragraph_dedup.near_duplicates(empty).count() == 0


def repeated_words(rows):
    seen = defaultdict(list)
    for i, t, *_ in rows:
        w = tokens(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].append((i, k))
    return {(i, k + j) for v in seen.values() if len(v) > 1 for i, k in v for j in range(50)}


@pytest.mark.parametrize("parts", ["2", "13"])
def test_repeated_spans_equal_brute_force(spark, parts):
    rows = corpus(3, 12)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        spans = suffix_dedup.repeated_spans(spark.createDataFrame(rows, COLUMNS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    covered = {(r["id"], k) for r in spans if not r["removed"] for k in range(r["start_word"], r["end_word"])}
    assert covered == repeated_words(rows)
    late = {(r["id"], k) for r in spans if r["removed"] for k in range(r["start_word"], r["end_word"])}
    assert late < covered


def removed_words(rows):
    seen = defaultdict(list)
    for i, t, *_ in rows:
        w = tokens(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].append((i, k))
    return {(i, k + j) for v in seen.values() for i, k in v if (i, k) != min(v) for j in range(50)}


def spans_of(spark, rows):
    spans = suffix_dedup.repeated_spans(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    return [{(r["id"], k) for r in spans if r["removed"] == late for k in range(r["start_word"], r["end_word"])} for late in (False, True)]


@pytest.mark.parametrize("heavy", [20_000, 5])
def test_one_of_many_sharers_is_kept(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    shared = words(70, 999)
    rows = [(i, words(40, 7000 + i) + " " + shared + " " + words(40, 9000 + i), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, " ".join(["same"] * 90 + [str(i)] + ["a b"] * 60), "en", "s", 1) for i in range(8)] + [(1000 + r[0], *r[1:]) for r in corpus(2, 12)]
    every, late = spans_of(spark, rows)
    assert late == removed_words(rows) and every == repeated_words(rows)
    assert sum((i, 75) in every and (i, 75) not in late for i in range(1, 120)) == 0


@pytest.mark.parametrize("heavy", [20_000, 5])
def test_passage_behind_a_common_line_is_found(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    line = words(30, 31)
    rows = [(i, words(45, 3000 + i) + " " + line + " " + words(45, 5000 + i), "en", "s", 1) for i in range(150)]
    for p in range(20):
        before = words(25, 800 + p)
        rows += [(1000 + 2 * p + c, f"{words(30, 6000 + 2 * p + c)} {before} {line} {words(30, 8000 + 2 * p + c)}", "en", "s", 1) for c in range(2)]
    every, late = spans_of(spark, rows)
    assert every == repeated_words(rows) and late == removed_words(rows)
    assert {i for i, _ in every} == set(range(1000, 1040)) and {i for i, _ in late} == set(range(1001, 1040, 2))


def test_spans_of_awkward_rows(awkward, empty):
    spans = [(r["id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_spans(awkward).where("NOT removed").collect()]
    found = Counter(i for i, *_ in spans)
    assert set(found) == {1, 2, 3, 11, 13} and (2, 0, 120) in spans and (13, 1, 121) in spans
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_workers_of_the_join_do_without_pandas(spark):
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import sys, glossaflow.llm.jaccard_join as j; print('pandas' in sys.modules, j.TEXTS_AT_ONCE <= 500)"], capture_output=True, text=True)
    assert said.stdout.split() == ["False", "True"], said.stderr


def test_settings_come_back(spark):
    from glossaflow.llm.common import swept

    rules = "spark.sql.adaptive.optimizer.excludedRules"
    assert spark.conf.get(rules, None) is None
    with swept(spark):
        assert "AQEPropagateEmptyRelation" in spark.conf.get(rules)
    assert spark.conf.get(rules, None) is None
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
