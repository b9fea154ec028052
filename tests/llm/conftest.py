import random

import pytest


def sentence(rng, n, words=400):
    return " ".join(f"w{int(words * rng.random() ** 3)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with results."""
    rng = random.Random(1)
    long = sentence(rng, 60_000)
    same = sentence(rng, 80)
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, same, "de", "b"), (5, same, "de", "b"), (5, same, "de", "b"), (None, same, "en", None), (6, long, "en", "a"), (7, "one two three", None, "c"), (8, "é ß 日本  x", "fr", "c")]
    rows = [(*r, 9, "x", 1.5, [1], 7) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kinds string, score double, ids array<int>, size long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
