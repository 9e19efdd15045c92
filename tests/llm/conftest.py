import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score string, w int"


@pytest.fixture(scope="session")
def prose():
    """Seeded words and sentences."""
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocab, k=n))


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    long = "\n".join(prose(12, i) for i in range(400))
    rows = [
        (1, prose(80, 1), "en", "a", 1, "k", "s", 1),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "k", "s", 1),
        (4, long, "de", "a", len(long), "k", "s", 1),
        (5, " \n\t \n", "fr", "a", 5, "k", "s", 1),
        (6, "日本語 текст été\n\n ß", "fr", None, 5, "k", "s", 1),
        (7, prose(80, 1), "en", "b", 1, "k", "s", 1),
        (7, prose(80, 1), "en", "b", 1, "k", "s", 1),
        (None, prose(60, 2), "de", "b", 1, "k", "s", 1),
        (9, "12345 !!! ###", None, "b", 1, "k", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
