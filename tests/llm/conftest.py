from __future__ import annotations

import random

import pytest

from cutpoint.llm.queries import importable

SCHEMA = "doc_id long, text string, lang string, source string, Stats string, kept string, IDS string, n_words string"


@pytest.fixture(scope="session")
def llm_spark(compiled_spark):
    importable(compiled_spark)
    return compiled_spark


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing column names."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(30_000))
    more = "x", "y", "z", "9"
    rows = [
        (1, "plain words here", "en", "b", *more),
        (1, "plain words here", "en", "b", *more),
        (2, None, None, None, None, None, None, None),
        (None, "", "en", "a", *more),
        (None, " \t\n ", None, "a", *more),
        (3, long, "de", None, *more),
        (4, long, "de", "a", *more),
        (5, "é日本 ▁▁ x y 😀" * 3, "fr", "c", *more),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(llm_spark, odd_rows):
    return llm_spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(llm_spark):
    return llm_spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(llm_spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (99, 1, 0)]
    return llm_spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
