from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

#: Texts that every document operator must bear: null, empty, blank, one word, repeats, a very long one.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (6, "a b c"), (None, "without an id here"),
    (7, "Ünïcödé ẞtraße naïve 東京 москва"), (8, "x" * 200_000), (9, "long text " * 30_000), (9, "same id other text"), (10, "\u0001\u0002 odd \u0003"),
]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def odd_docs(spark):
    """Rows of ODD with clashing extra columns; n_chars and lang are null."""
    rows = [(i, t, None, None, None, "k", 1, "s") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node int, score string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
