from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, h bigint, size string, items string, score string"


@pytest.fixture
def odd_documents(spark):
    """NULLs in every column, empty and repeated rows, one id twice, a long text, columns named like the operators' own."""
    words = " ".join(f"word{i % 97}x{i % 89}" for i in range(6000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and then runs far away", "en", "a", 1, "s", "i", "x"),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, "b", 1, "s", "i", "x"),
        (4, " \n\t ", "de", None, 1, "s", "i", "x"),
        (5, "12 + 34 = 46 !!!", "de", None, 1, "s", "i", "x"),
        (6, words, "en", "b", 1, "s", "i", "x"),
        (7, words, "en", "b", 1, "s", "i", "x"),
        (8, "ein Satz auf Deutsch, der nicht sehr lang ist", "de", "c", 1, "s", "i", "x"),
        (8, "ein Satz auf Deutsch, der nicht sehr lang ist", "de", "c", 1, "s", "i", "x"),
        (9, "one text under an id", "en", "c", 1, "s", "i", "x"),
        (9, "another text under the same id", "en", "c", 1, "s", "i", "x"),
        (None, "a text without an id", "en", "d", 1, "s", "i", "x"),
        (10, "the", "en", "d", 1, "s", "i", "x"),
        (11, "ünïcödé 日本語 \U0001f600 ###</turn>\\", "en", "d", 1, "s", "i", "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
