"""Small scalars: names, headers, case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a file in which its header is looked for.
HEADER_SIZE = 8192


def header_field(content: Column, field: str) -> Column:
    """The value of ``field:`` in the header comment at a file's start; null without one."""
    head = F.substring(content, 1, HEADER_SIZE)
    found = F.regexp_extract(head, rf"(?mi)^[ \t/*#@]*{field}:[ \t]*(.+?)[ \t]*$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def release_header(content: Column, field: str) -> Column:
    """``header_field`` as release tools read it: the opening tag may share its line, lines may
    end in CR alone, and a closing comment or tag is cut off."""
    head = F.regexp_replace(F.substring(content, 1, HEADER_SIZE), "\r\n?", "\n")
    found = F.regexp_extract(head, rf"(?mi)^(?:[ \t]*<\?php)?[ \t/*#@]*{field}:(.*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s*(?:\*/|\?>).*", "")), F.lit(""))


def iso_utc(ts: Column) -> Column:
    """A UTC timestamp as text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
