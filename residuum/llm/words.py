"""Column expressions for words: runs of anything but space and \\x09-\\x0D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character of the word definition, and of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(whole(text), SPACE + "+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is. For short strings."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
