"""Changes to a text before it is split: functions from Column to Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

CharFilter = Callable[[Column], Column]


def html_strip(text: Column) -> Column:
    """Every tag and every entity becomes a blank; the text of scripts stays."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>?", " "), r"&[A-Za-z0-9_]*;", " ")


def mapping(table: Mapping[str, str]) -> CharFilter:
    """Replace literal strings, longest first."""

    def apply(text: Column) -> Column:
        for old in sorted(table, key=lambda k: (-len(k), k)):
            text = F.replace(text, F.lit(old), F.lit(table[old]))
        return text

    return apply


def pattern_replace(pattern: str, replacement: str) -> CharFilter:
    """Replace by a regular expression."""
    return lambda text: F.regexp_replace(text, pattern, replacement)
