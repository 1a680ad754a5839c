from __future__ import annotations

import pytest

#: Nulls everywhere, empty and blank texts, repeated rows, a tie, a long text, clashing column names.
LONG = " ".join(f"word{i % 997} other{i % 31}" for i in range(40_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1, "x", 0.5),
    (2, "alpha beta gamma delta epsilon zeta", "en", "a", 1, "x", 0.5),
    (2, "alpha beta gamma delta epsilon zeta", "en", "a", 1, "x", 0.5),
    (3, None, None, None, None, None, None),
    (None, "no id here at all , but words", "en", "b", 2, "y", None),
    (4, "", "de", "b", 0, "y", 1.0),
    (5, " \n\t \n", "de", "", 0, "y", 1.0),
    (6, LONG, "en", "c", len(LONG), "z", 1.0),
    (7, "zwei drei\nvier fünf\n\nzwei drei", "de", "c", 5, "z", 1.0),
    (8, "😀 ünïcödé   text\rwith\x0bodd\x1cspaces", None, None, 5, "z", 1.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
