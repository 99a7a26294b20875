import random

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    parts = "er in the of and an re tion es or nd ti ha le".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies."""
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "en", None),
        (4, None, "en", "a"),
        (5, "", None, "a"),
        (6, " \n\t ", "en", "b"),
        (7, "one", "en", "b"),
        (8, "One", "fr", "b"),
        (9, words(30_000, 2), "en", "a"),
        (10, words(70, 3), None, None),
        (11, words(70, 4) + "\n" + words(70, 5) + "\n" + words(70, 4), "de", "c"),
        (12, "a" * 50_000, "de", "c"),
        (1, base, "en", "a"),
        (None, base, "en", "a"),
        (13, "x " + base + " y", "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows with more columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(awkward_rows(), COLUMNS)
    for name in ("id", "n", "base", "words", "label", "score", "key", "mark", "n_words", "_lang"):
        df = df.withColumn(name, F.lit("extra"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
