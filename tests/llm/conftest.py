import random

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "ß", "MIT", "License", "the", "idiot"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, long = make(60), make(30_000)
    data = [
        (1, passage, "en", "a", 1), (1, passage, "en", "a", 1), (2, passage + " tail", None, "a", 2), (3, None, "en", None, None), (None, passage, "de", "b", 3),
        (4, "", "de", "b", 4), (5, " \t\n\x0b\x0c\r", None, None, 5), (6, long, "en", "a", 6), (7, long + " more", "en", "a", 7), (8, "one", "fr", "c", 8), (9, "one", "fr", "c", 9),
        (10, "a b c d", "fr", "c", 1), (11, "A B C D", "fr", None, 1), (12, "x\ny\nx\n\n \ny y", "fr", "c", 1), (13, "7 8 9 ### $$ %", "xx", "c", 1), (13, "other text for the same id", "xx", "c", 1),
        (None, None, None, None, None), (14, "Released under the MIT License. É", "en", "d", 0), (15, "!" * 50_000, "en", "d", 0),
    ]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, kept long").withColumnsRenamed({"kept": "id0"})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
