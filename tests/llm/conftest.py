"""Small documents with everything that is awkward."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count string, row string, component_id string"


@pytest.fixture(scope="session")
def prose():
    """A maker of sentences from a few syllables: same seed, same text."""
    import random

    def make(seed, words=120, syllables=("ka", "lo", "mi", "ren", "tas", "vu", "der", "on")):
        r = random.Random(seed)
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(words)) + "."

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named as results are."""
    long = " ".join(prose(i, 400) for i in range(60))
    texts = [prose(1), prose(1), None, "", "   \n\t ", "one two", "one two", long, prose(2).upper(), prose(3) + " x", prose(3) + " y", " 　 \x1c é ß 漢字 🙂", "a" * 50_000]
    rows = [(i, t, None if i % 5 == 4 else "aa", None if i % 4 == 3 else f"s{i % 3}", None, "c", "r", "k") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, prose(1), "aa", "s0", 1, None, None, None), (None, None, None, None, None, None, None, None), (5, "another text of the same id", "aa", "s1", 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
