import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and white texts, repeated rows, ties, a very long text, and
    extra columns with the names that operators use inside."""
    long = " ".join(f"word{k % 977} other{k % 31}" for k in range(20_000))
    body = "The quick brown fox jumps over the lazy dog while seven wizards mix strong potions near the old mill by the river each night."
    rows = [
        (1, body, "en", "a"),
        (2, body, "en", "a"),
        (2, body, "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \t\n ", "de", None),
        (6, "one", "en", "c"),
        (7, long, "en", "c"),
        (8, long + " end", None, None),
        (None, body + " And more of it.", "en", "a"),
        (None, None, None, None),
        (9, "é ü ñ \u4e2d\u6587 \U0001f600 <|endoftext|> x", "fr", "d"),
    ]
    rows = [r + (len(r[1] or ""), "x", 1, "y", 2) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string, row int, key string, copies int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
