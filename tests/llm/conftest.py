import random

import pytest

ODD = [
    (None, None, "en", "a", 7), (1, "", None, None, 7), (2, " \n\t ", "en", "b", 7), (3, "one two", "en", "b", 7),
    (3, "one two", "en", "b", 7), (4, None, "fr", "a", 7), (5, "word " * 30000, "en", "c", 7), (None, "one two", "en", "a", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and a column whose name clashes with results."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
