"""Queries as immutable values.

``&``, ``|`` and ``~`` combine them; every query has a ``boost``.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Query:
    boost: float = field(default=1.0, kw_only=True)

    def boosted(self, by: float) -> Query:
        return dataclasses.replace(self, boost=self.boost * by)

    def __and__(self, other: Query) -> Query:
        return Bool(must=(self, other))

    def __or__(self, other: Query) -> Query:
        return Bool(should=(self, other))

    def __invert__(self) -> Query:
        return Bool(must_not=(self,))


@dataclass(frozen=True)
class TermQ(Query):
    field: str
    term: str


@dataclass(frozen=True)
class TermsQ(Query):
    """Any of the terms; the score is the boost."""

    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class TermRangeQ(Query):
    field: str
    low: str | None = None
    high: str | None = None
    with_low: bool = True
    with_high: bool = True


@dataclass(frozen=True)
class PrefixQ(Query):
    field: str
    prefix: str


@dataclass(frozen=True)
class WildcardQ(Query):
    """``*`` for any run of characters, ``?`` for one."""

    field: str
    pattern: str


@dataclass(frozen=True)
class RegexpQ(Query):
    """A match anywhere in the term."""

    field: str
    pattern: str


@dataclass(frozen=True)
class FuzzyQ(Query):
    """Terms within ``edits``; the ``most`` nearest, then most frequent, then first."""

    field: str
    term: str
    edits: int = 2
    most: int = 64


@dataclass(frozen=True)
class RangeQ(Query):
    """A column between bounds, both included; of an array, any value."""

    column: str
    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class PointsQ(Query):
    column: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class ExistsQ(Query):
    column: str


@dataclass(frozen=True)
class AllQ(Query):
    pass


@dataclass(frozen=True)
class NoneQ(Query):
    reason: str = ""


@dataclass(frozen=True)
class BoxQ(Query):
    field: str
    south: float
    west: float
    north: float
    east: float


@dataclass(frozen=True)
class NearQ(Query):
    field: str
    lat: float
    lon: float
    metres: float


@dataclass(frozen=True)
class PhraseQ(Query):
    field: str
    terms: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class MultiPhraseQ(Query):
    """Alternatives for each slot; ``places`` are the slots' expected positions."""

    field: str
    groups: tuple[tuple[str, ...], ...]
    places: tuple[int, ...] | None = None
    slop: int = 0


@dataclass(frozen=True)
class Source:
    """A set of intervals of positions."""


@dataclass(frozen=True)
class ITerm(Source):
    term: str


@dataclass(frozen=True)
class IPhrase(Source):
    terms: tuple[str, ...]


@dataclass(frozen=True)
class IOr(Source):
    sources: tuple[Source, ...]


@dataclass(frozen=True)
class IOrdered(Source):
    sources: tuple[Source, ...]
    max_gaps: int = -1


@dataclass(frozen=True)
class IUnordered(Source):
    sources: tuple[Source, ...]
    max_gaps: int = -1


@dataclass(frozen=True)
class IContaining(Source):
    big: Source
    small: Source


@dataclass(frozen=True)
class IContainedBy(Source):
    small: Source
    big: Source


@dataclass(frozen=True)
class INotContaining(Source):
    big: Source
    small: Source


@dataclass(frozen=True)
class IntervalsQ(Query):
    field: str
    source: Source


@dataclass(frozen=True)
class SpanTermQ(Query):
    field: str
    term: str


@dataclass(frozen=True)
class SpanNearQ(Query):
    clauses: tuple[Query, ...]
    slop: int = 0
    in_order: bool = True


@dataclass(frozen=True)
class SpanOrQ(Query):
    clauses: tuple[Query, ...]


@dataclass(frozen=True)
class SpanNotQ(Query):
    """Documents of ``include`` that have no span of ``exclude``."""

    include: Query
    exclude: Query


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    least_should: int = 0
    #: A query of exclusions alone matches nothing instead of all other documents.
    strict: bool = False


@dataclass(frozen=True)
class ConstantQ(Query):
    inner: Query
    score: float = 1.0


@dataclass(frozen=True)
class DisMaxQ(Query):
    parts: tuple[Query, ...]
    tie: float = 0.0


@dataclass(frozen=True)
class FunctionQ(Query):
    """Combine the score with a column: multiply, replace, sum or max."""

    inner: Query
    column: str
    mode: str = "multiply"


@dataclass(frozen=True)
class CombinedQ(Query):
    fields: tuple[str, ...]
    terms: tuple[str, ...]
    least: int = 1
    weights: tuple[float, ...] | None = None
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class RrfQ(Query):
    """Reciprocal rank fusion of the first ``depth`` hits of each part."""

    parts: tuple[Query, ...]
    k: int = 60
    depth: int = 100


@dataclass(frozen=True)
class ParentQ(Query):
    """Parents (rows named by ``parent``) of matching children."""

    child: Query
    parent: str = "parent_id"


@dataclass(frozen=True)
class LikeQ(Query):
    """Documents like one document, by its most telling terms."""

    doc_id: int
    fields: tuple[str, ...]
    min_tf: int = 1
    min_df: int = 1
    max_df: int | None = None
    min_length: int = 3
    most: int = 25
    weigh: bool = True


@dataclass(frozen=True)
class VectorQ(Query):
    """The ``k`` nearest vectors by cosine, among those ``where`` matches.

    With ``probes`` only that many clusters are looked at, where the searcher
    has clusters of the column; without, the search is exact.
    """

    column: str
    vector: tuple[float, ...]
    k: int = 10
    where: Query | None = None
    probes: int = 0


def phrase_of(field: str, places: list[list[str]], slop: int = 0) -> Query | None:
    """Terms by position as a term, alternatives, or a phrase; None where there are none."""
    if not places:
        return None
    if len(places) == 1:
        return TermQ(field, places[0][0]) if len(places[0]) == 1 else Bool(should=tuple(TermQ(field, t) for t in places[0]))
    if all(len(p) == 1 for p in places):
        return PhraseQ(field, tuple(p[0] for p in places), slop)
    return MultiPhraseQ(field, tuple(tuple(p) for p in places), slop=slop)


def and_(*queries: Query) -> Query:
    return Bool(must=queries)


def or_(*queries: Query, least: int = 0) -> Query:
    return Bool(should=queries, least_should=least)


def not_(*queries: Query) -> Query:
    return Bool(must_not=queries)
