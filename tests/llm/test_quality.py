import re
from collections import Counter

from glossaflow.llm import quality_model, quality_rules, toxicity
from glossaflow.llm.common import held_out_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_equal_a_plain_version(awkward):
    got = Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.quality(awkward).collect())
    assert got == Counter((r["doc_id"], *counts(r["text"])) for r in awkward.select("doc_id", "text").collect())


def test_counts_of_odd_lines(spark):
    texts = ["a\na\n\n \na \na", "é# **\né# **", "x y x y x y", "| | |\r\n| | |\r\n", "\n\n", "a\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").selectExpr("*", "'en' AS lang", "'s' AS source")
    for r in quality_rules.add_counts(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(r["text"]), r["text"]


def test_sketches_merge_and_bound_the_quantile(spark):
    values = spark.range(3000).selectExpr("id * id AS v")
    b = values.select("v", quality_rules.bucket(values["v"]).alias("b"))
    for r in b.select("v", quality_rules.bucket_floor(b["b"]).alias("low")).collect():
        assert r["low"] <= r["v"] <= max(r["low"] * 1.125, 15)


def test_junk_goes_and_clean_stays(spark, empty):
    from .conftest import COLUMNS, words

    rows = [(i, words(100, 100 + i).capitalize(), "en", f"s{i % 2}", 1) for i in range(300)]
    junk = [(1000, " ".join(w + "###" for w in words(100, 7).split()), "en", "s0", 1), (1001, (words(100, 8).upper()).replace(" ", "!! "), "en", "s1", 1), (1002, "be " * 200, "en", "s0", 1)]
    kept = {r["doc_id"] for r in quality_rules.keep_good(spark.createDataFrame(rows + junk, COLUMNS)).collect()}
    assert kept == {r[0] for r in rows}
    assert quality_rules.keep_good(empty).count() == 0
    assert quality_rules.keep_good(empty).columns == empty.columns


def labelled(spark):
    from .conftest import COLUMNS, words

    rows, labels = [], []
    for i in range(600):
        text = words(80, i)
        toxic, quality = int(i % 7 == 0), int(i % 5 != 0)
        if toxic:
            at = text.split()
            for k in range(0, 80, 20):
                at[k] = ("idiot", "1diot", "m0ron", "scumbag")[k // 20]
            text = " ".join(at)
        if not quality:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, quality, toxic))
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r for r in labels.collect()}
    for made, label in ((quality_model.quality_scores(docs, labels), "quality"), (toxicity.toxicity_scores(docs, labels), "toxic")):
        rows = made.collect()
        assert all(r["held_out"] == held_out_id(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
        out = [r for r in rows if r["held_out"]]
        assert sum(r["predicted"] == truth[r["doc_id"]][label] for r in out) >= 0.97 * len(out)


def test_scores_of_awkward_rows_and_missing_labels(spark, awkward, empty):
    docs, labels = labelled(spark)
    none = labels.where("false")
    for make in (quality_model.quality_scores, toxicity.toxicity_scores):
        rows = make(awkward, labels).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert {r["score"] for r in make(docs.limit(3), none).collect()} == {0.5}
        assert make(empty, none).count() == 0


def test_folding_and_exceptions(spark):
    rows = [(f"you are an idiot {i} word{i}", 1) for i in range(30)] + [(f"a calm text {i} word{i}", 0) for i in range(60)]
    rows += [(f"village idiot festival number {i}", 0) for i in range(1)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text STRING, label INT"), frozenset({"village idiot"}))
    assert lexicon.score("what an 1d1ot here") > 0.5
    assert lexicon.score("what an іdіоt here") > 0.5  # Cyrillic letters
    assert lexicon.score("what an ｉ𝐝ｉｏｔ here") > 0.5  # wide and mathematical letters
    assert lexicon.score("the village idiot festival") < 0.5
    assert lexicon.score(None) == lexicon.score("") < 0.5


def test_matches_equal_a_plain_search(spark):
    """Every term and exception phrase looked for one by one at every place."""
    import math
    import random

    rng = random.Random(4)
    parts = ["idiot", "idiocy", "moron", "the", "village", "fool", "foolish", "of", "ass", "assign"]
    weights = {"idio": 1.5, "moron ": 2.0, "fool": 1.25, "ass ": 3.0, "foolish ": 0.5}
    lexicon = toxicity.Lexicon(weights, frozenset({"village idiot", "fool of", "of fool of"}))
    for _ in range(200):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        folded = toxicity.fold(text)
        spans = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        total = 0.0
        for t, w in weights.items():
            for i in range(len(folded)):
                if folded.startswith(" " + t, i) and not any(a <= i and i + len(t) <= b + 1 for a, b in spans):
                    total += w
        assert lexicon.signals(text) == (math.log1p(total), 100 * total / max(folded.count(" ") - 1, 1)), text


def test_counts_of_terms_equal_plain_counts(spark):
    from .conftest import words

    rows = [(words(30, i) + (" scumbag" if i % 2 else ""), i % 2) for i in range(60)]
    got = {(r["term"], r["label"]): r["n"] for r in toxicity._counted(spark.createDataFrame(rows, "text STRING, label INT").repartition(3), toxicity._terms_of, toxicity.TERMS).collect()}
    plain = Counter((t, label) for text, label in rows for t in {t for w in set(toxicity.fold(text).split()) for t in toxicity.beginnings(w)})
    assert got == plain


def test_identity_equals_the_sum_over_pairs():
    """The sum-of-squares identity against the double loop over pairs of features."""
    import numpy as np
    import pyarrow as pa

    from glossaflow.llm.wordhash import column_buffers

    from .conftest import words

    data, offsets = column_buffers(pa.array([words(12, 1), "", words(7, 2) + "\n# !", None, "one"]))
    x = quality_model.features(data, offsets, 0, 5)
    rng = np.random.default_rng(1)
    size = quality_model.WORD_BINS + quality_model.STATS
    m = quality_model.Machine(0.3, rng.normal(size=size).astype(np.float32), rng.normal(size=(size, quality_model.FACTORS)).astype(np.float32))
    expected = []
    for a, b in zip(x.bounds[:-1], x.bounds[1:], strict=True):
        i, v = x.index[a:b], x.value[a:b].astype(float)
        pairs = sum(float(m.factors[i[p]].astype(float) @ m.factors[i[q]].astype(float)) * v[p] * v[q] for p in range(len(i)) for q in range(p))
        expected.append(0.3 + float(m.weights[i].astype(float) @ v) + pairs)
    assert np.allclose(m.raw(x), expected, rtol=1e-4, atol=1e-4)


def test_training_rows_are_bounded(spark):
    from glossaflow.llm.labelled import training_rows

    docs = spark.range(2000).selectExpr("1L AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(2, None), (3, "three")], "doc_id BIGINT, text STRING"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (4, None)], "doc_id BIGINT, quality INT")
    rows = {r["id"]: (r["text"], r["label"]) for r in training_rows(docs, labels, "quality", 10).collect()}
    assert rows.items() <= {1: ("text 0", 1), 2: ("", 0), 3: ("three", 1)}.items() and len(rows) >= 2
    assert training_rows(docs, labels, "quality", 1).count() == 1
