import random
import re
from collections import Counter

from glossaflow.llm import phrase_mining

from .conftest import words


def plain(rows, least=10, percent=50, most=2000):
    """Counts by nested loops over (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    held = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in held.items():
        longer = [b for (other, q), b in held.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most])}


def result(df, **args):
    return {tuple(r) for r in phrase_mining.collocations(df, **args).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def rows_of(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


def test_awkward_rows(awkward, empty):
    assert result(awkward) == plain(rows_of(awkward))
    assert result(empty) == set()


def test_pieces_dense_words_and_ties(spark):
    rng = random.Random(1)
    rows = [(lang, " ".join(rng.choice(["the", "THE", "a b", "é\x1cz", "日本", "x.", "\t,y", "of", "q\n", "ré"]) for _ in range(rng.randint(0, 80)))) for lang in ("en", None, "und", "fr") for _ in range(60)]
    rows += [("en", None), ("fr", ""), (None, " . ! "), ("en", "the " * 500)]
    df = spark.createDataFrame(rows, "lang STRING, text STRING").repartition(5)
    expected = plain(rows)
    assert len({r[0] for r in expected}) == 3 and len(expected) > 40
    assert result(df) == expected
    assert result(df, most=3) == plain(rows, most=3)
    assert result(df, least=2, percent=80) == plain(rows, least=2, percent=80)


def test_shards_and_blocks_do_not_matter(spark, monkeypatch):
    rows = [("en", words(300, i % 7)) for i in range(20)] + [("de", words(40, 3) + ", " + words(40, 4))] * 12
    df = spark.createDataFrame(rows, "lang STRING, text STRING").repartition(2)
    expected = plain(rows)
    assert result(df) == expected
    shards = list(phrase_mining._shards(iter([_batch(rows)])))
    monkeypatch.setattr(phrase_mining, "SHARD_BYTES", 500)
    monkeypatch.setattr(phrase_mining, "BLOCK", 7)
    monkeypatch.setattr(phrase_mining, "SPARSE", 4)
    small = list(phrase_mining._shards(iter([_batch(rows)])))
    assert len(small) > len(shards)
    assert _local(small) == _local(shards)


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})


def _local(shards):
    """The sums of popcounts over shards, with no word left out."""
    import numpy as np

    total = Counter()
    for lang, s in shards:
        leads = np.append(~s.first[1:], False)
        names = s.vocabulary.to_pylist()
        for phrase, count in phrase_mining.Bitmaps(s, np.ones(len(names), bool), leads).phrases():
            for *p, c in zip(*phrase, count, strict=True):
                total[lang, " ".join(names[w] for w in p)] += int(c)
    return total


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 2, "a b", 3_000_000_000), ("en", 1, "a", 4_000_000_000), ("en", 1, "b", 7_000_000_001), ("en", 0, "", 9_000_000_000)], "lang STRING, k INT, phrase STRING, n BIGINT")
    row = phrase_mining.scored(counts).first()
    assert row["score"] == 1_000_000 * 3_000_000_000**2 // (4_000_000_000 * 7_000_000_001)
