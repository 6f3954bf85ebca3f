import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, keep string"


def words(rng, n, base="able beta cora delta echo fox gala horn iris jazz kilo lima".split()):
    return " ".join(rng.choice(base) + rng.choice(["", "", "s", "ed", ".", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents with further columns whose names are those of our results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), 1.5, "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(3)
    a = words(rng, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, a), (4, a), (4, a), (5, a + " tail"), (6, words(rng, 30_000)),
        (7, "é" * 50 + " \x85 \U0001f600 x\x1cy <|endoftext|> z"), (8, "one"), (9, "one two"), (10, "One TWO"),
        (11, a, None, None), (12, words(rng, 60), "fr", ""), (12, words(rng, 61), "fr", "b"),
    ]
