"""Splitting text into terms on the Python side.

A term is a maximal run of letters or decimal digits, lower-cased.
"""

from __future__ import annotations

import regex

_BLANKED = {i: " " for i in range(128) if not chr(i).isalnum()}
_TERM = regex.compile(r"[\p{L}\p{Nd}]+")

#: The same pattern for Spark SQL and DuckDB.
TERM_PATTERN = r"[\p{L}\p{Nd}]+"


def terms(text: str) -> list[str]:
    """Every term of ``text`` in order; ASCII texts avoid the regex engine."""
    low = text.lower()
    if low.isascii():
        return low.translate(_BLANKED).split()
    return _TERM.findall(low)
