from __future__ import annotations

import pytest

#: Nulls, empty and long texts, ties and repeated rows, and extra columns whose names operators use inside.
ROWS = [
    (1, "the cat sat on the mat and looked at the dog. " * 3, "en", "a", 5, "x"),
    (2, "the cat sat on the mat and looked at the dog. " * 3, "en", "a", 5, "x"),
    (2, "the cat sat on the mat and looked at the dog. " * 3, "en", "a", 5, "x"),
    (3, None, "en", "b", None, None),
    (4, "", None, None, 0, ""),
    (None, "ein Haus am See mit vielen Fenstern", "de", "b", 1, "y"),
    (6, "Straße über Flüße, schöne Grüße\nStraße über Flüße", "de", "b", 1, "y"),
    (7, " \n\t ", "de", "c", 1, "y"),
    (8, "word " * 30_000 + "end", "en", "c", 1, "y"),
    (9, "mail a.b@example.com or call +1 (348) 555-2423 from 10.0.0.1", "en", "c", 1, "y"),
    (10, "emoji \U0001f600 and 你好 and \u0000 too", "zh", "c", 1, "y"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, node string"


@pytest.fixture(scope="session")
def odd(spark):
    """A table of odd rows."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
