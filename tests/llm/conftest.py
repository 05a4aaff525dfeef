import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture
def prose():
    """Texts of made-up words; the same seed gives the same text."""

    def make(words: int, seed: int, vocabulary: int = 400) -> str:
        pick = random.Random(seed)
        known = ["".join(pick.choice(LETTERS) for _ in range(pick.randint(2, 9))) for _ in range(vocabulary)]
        return " ".join(pick.choice(known) for _ in range(words))

    return make


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, spans string, features string, kept string, n_words string, version string, found string"


@pytest.fixture
def awkward(spark, prose):
    """Nulls in every column, empty and long texts, repeated rows, and further
    columns named like results."""
    long = prose(30_000, 1)
    texts = [None, "", " \t\n", "one", long, long, prose(80, 2), prose(80, 2), "x" * 100_000, "é" * 50 + ' password: "hunter2secret"']
    rows = [(i, t, None if i == 3 else "en", None if i in (2, 6) else f"s{i % 3}", None, "a", "b", "c", "d", "e", "f", "g", "h") for i, t in enumerate(texts)]
    rows += [rows[6], (None, prose(80, 2), None, None, None, *[None] * 8), (None, None, None, None, None, *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 0, 1), (7, 0, 0), (None, 1, 1), (4, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
