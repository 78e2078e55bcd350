"""Small tables with the awkward rows every operator has to take."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, ids string, score string"


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and clashing extra columns."""
    long_text = "word " * 60_000 + "end"
    rows = [
        (1, None, "en", "a", None, "x", "i", "s"),
        (2, "", "en", "a", 0, "x", "i", "s"),
        (3, " \t\n\r ", None, None, 5, None, None, None),
        (4, long_text, "en", "a", len(long_text), "x", "i", "s"),
        (5, "one two", "en", None, 7, "x", "i", "s"),
        (5, "one two", "en", None, 7, "x", "i", "s"),
        (None, "one two", None, "b", 7, "x", "i", "s"),
        (6, "x" * 100_000, "de", "b", 100_000, "x", "i", "s"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)
