import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty texts, long texts, ties, repeats, and columns with clashing names."""
    rows = [(1, "alpha beta gamma delta epsilon", "en", "s"), (2, None, None, None), (3, "", "fr", "s"), (4, " \t\n ", "de", "s"),
            (5, "alpha beta gamma delta epsilon", "en", "s"), (6, "Ünïcödé wörds, 123", None, "s"), (7, "123 456 !!", "en", None),
            (8, "word " * 30_000, "en", "s"), (9, "x", "es", "s"), (9, "x", "es", "s"), (None, "no id here", "en", "s")]
    return spark.createDataFrame([(i, t, g, s, len(t) if t else None, 0.5, 1, "k") for i, t, g, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, length int, piece string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
