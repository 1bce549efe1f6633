import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


SCHEMA = "doc_id long, text string, source string, `id` string, `key` int, `part` string, `at` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like internal ones."""
    long_text = " ".join(f"word{i % 977} of the long{i % 31} text." for i in range(20_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one", "b"), (None, "a null id of its own", "b"),
        (6, long_text, "a"), (7, long_text, "a"), (8, "Ünï çödé ñ text with the ends of days.", "ß"),
        (9, "repeated row", "c"), (9, "repeated row", "c"), (10, "the and of", None),
    ]
    return spark.createDataFrame([(i, t, s, "x", 1, "y", None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
