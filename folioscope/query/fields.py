"""Predicates on fields as queries: ``f.source == "wire"``, ``f.year >= 2000``, ``f.body.has("word")``.

Comparisons of text and string fields become queries of terms, those of other
columns ranges and points; ``&``, ``|`` and ``~`` combine them.
"""

from __future__ import annotations

from typing import Any

from ..index.schema import FieldSpec
from . import nodes as q


class Field:
    """One field of an index, or a plain column where the index has none of that name."""

    def __init__(self, name: str, spec: FieldSpec | None = None):
        self.name, self.spec = name, spec

    def _terms(self, value: str) -> list[str]:
        return self.spec.analyser.of(value) if self.spec is not None and self.spec.kind == "text" else [value]

    @property
    def _posted(self) -> bool:
        return self.spec is not None and self.spec.kind in ("text", "string")

    def __eq__(self, value: Any) -> q.Query:  # type: ignore[override]
        if value is None:
            return ~self.exists()
        if not self._posted:
            return q.PointsQ(self.name, (value,))
        places = self.spec.analyser.places(value) if self.spec.kind == "text" else [[value]]
        return q.phrase_of(self.name, places) or q.NoneQ("no term")

    def __ne__(self, value: Any) -> q.Query:  # type: ignore[override]
        return ~(self == value)

    __hash__ = None  # type: ignore[assignment]

    def __ge__(self, low: Any) -> q.Query:
        return q.TermRangeQ(self.name, low, None) if self._posted else q.RangeQ(self.name, low, None)

    def __le__(self, high: Any) -> q.Query:
        return q.TermRangeQ(self.name, None, high) if self._posted else q.RangeQ(self.name, None, high)

    def __gt__(self, low: Any) -> q.Query:
        return q.TermRangeQ(self.name, low, None, with_low=False) if self._posted else self._open(self >= low, low)

    def __lt__(self, high: Any) -> q.Query:
        return q.TermRangeQ(self.name, None, high, with_high=False) if self._posted else self._open(self <= high, high)

    def _open(self, inside: q.Query, edge: Any) -> q.Query:
        return q.Bool(must=(inside,), must_not=(q.PointsQ(self.name, (edge,)),))

    def between(self, low: Any, high: Any) -> q.Query:
        return q.TermRangeQ(self.name, low, high) if self._posted else q.RangeQ(self.name, low, high)

    def isin(self, *values: Any) -> q.Query:
        if not self._posted:
            return q.PointsQ(self.name, tuple(values))
        return q.TermsQ(self.name, tuple(t for v in values for t in self._terms(v)))

    def exists(self) -> q.Query:
        return q.ExistsQ(self.name)

    def has(self, *words: str) -> q.Query:
        """All of the words, anywhere in the field."""
        return q.and_(*[q.TermQ(self.name, t) for w in words for t in self._terms(w)])

    def startswith(self, prefix: str) -> q.Query:
        return q.PrefixQ(self.name, prefix)

    def endswith(self, suffix: str) -> q.Query:
        return q.WildcardQ(self.name, f"*{suffix}")

    def contains(self, part: str) -> q.Query:
        return q.WildcardQ(self.name, f"*{part}*")

    def matches(self, pattern: str) -> q.Query:
        return q.RegexpQ(self.name, pattern)


class Fields:
    """The fields of an index by attribute."""

    def __init__(self, fields: dict[str, FieldSpec]):
        self._fields = fields

    def __getattr__(self, name: str) -> Field:
        return Field(name, self._fields.get(name))
