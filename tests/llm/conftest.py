import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from texts import prose  # noqa: E402

ROWS = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty and long texts, copies, null ids and sources, columns with clashing names."""
    long = prose(1, 9000)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one two", "en", "a"),
        (5, "onetwo", "en", "b"), (6, "one  two", "en", "b"), (6, "one  two", "en", "b"), (7, long, "en", "b"),
        (8, long + " tail", "en", None), (9, "é日本 🎉 \x00", "fr", ""), (None, "one two", "en", "a"), (10, "x" * 20000, "de", "b"),
    ]
    df = spark.createDataFrame(rows, ROWS)
    return df.selectExpr("*", "1 AS keep", "2 AS copies", "3 AS size", "'z' AS value", "4 AS component")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ROWS)
