"""Phrases as array expressions, intervals as an algebra on positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..query import nodes as q


def chain(slots: list[Column], slop: int) -> Column:
    """Whether the slots follow one another.

    From each place of the first slot the next slot's first place within
    ``slop`` of the expected one is taken, without going back.
    """

    def step(at: Column, slot: Column) -> Column:
        if slop == 0:
            return F.when(F.array_contains(slot, at + 1), at + 1)
        return F.get(F.filter(slot, lambda x: x.between(at + 1 - slop, at + 1 + slop)), F.lit(0))

    def follow(start: Column) -> Column:
        return reduce(step, slots[1:], start).isNotNull()

    return F.exists(slots[0], follow)


def loose_chain(slots: list[Column], places: list[int], slop: int) -> Column:
    """Whether the slots rise with a total deviation from ``places`` of at most ``slop``."""
    def step(state: Column, slot: Column, gap: int) -> Column:
        off = lambda x: F.abs(x - state["at"] - gap) + state["off"]
        fits = F.filter(slot, lambda x: (x >= state["at"]) & (off(x) <= slop))
        return F.transform(fits, lambda x: F.struct(x.cast("int").alias("at"), off(x).cast("int").alias("off")))

    def advance(states: Column, slot: Column, gap: int) -> Column:
        return F.array_distinct(F.flatten(F.transform(states, lambda st: step(st, slot, gap))))

    states = F.transform(slots[0], lambda x: F.struct(x.cast("int").alias("at"), F.lit(0).alias("off")))
    for slot, gap in zip(slots[1:], (b - a for a, b in zip(places, places[1:]))):
        states = advance(states, slot, gap)
    return F.size(states) > 0


def near(slots: list[Column], slop: int, in_order: bool) -> Column:
    """Whether consecutive slots start within ``slop + 1`` of each other."""
    def close(slot: Column, at: Column) -> Column:
        return F.filter(slot, lambda x: (F.abs(x - at) <= slop + 1) & ((x > at) if in_order else (x != at)))

    def advance(states: Column, slot: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(states, lambda at: close(slot, at))))

    return F.size(reduce(advance, slots[1:], slots[0])) > 0


Span = tuple[int, int]


def spans_of(source: q.Source, places: dict[str, list[int]]) -> list[Span]:
    """Intervals of a source in one document, by start and end."""
    match source:
        case q.ITerm(term):
            return [(p, p + 1) for p in places.get(term, ())]
        case q.IPhrase(terms):
            rest = [set(places.get(t, ())) for t in terms[1:]]
            return [(p, p + len(terms)) for p in places.get(terms[0], ()) if all(p + i + 1 in r for i, r in enumerate(rest))]
        case q.IOr(parts):
            return sorted({s for p in parts for s in spans_of(p, places)})
        case q.IOrdered(parts, most):
            # per end, how few gaps lead to it, from each start
            runs: dict[tuple[int, int], int] = {s: 0 for s in spans_of(parts[0], places)}
            for part in parts[1:]:
                after: dict[tuple[int, int], int] = {}
                options = spans_of(part, places)
                for (start, end), gaps in runs.items():
                    for s, e in options:
                        total = gaps + s - end
                        if s >= end and (most < 0 or total <= most) and total < after.get((start, e), total + 1):
                            after[(start, e)] = total
                runs = after
            return sorted(runs)
        case q.IUnordered(parts, most):
            return _unordered([spans_of(p, places) for p in parts], most)
        case q.IContaining(big, small):
            inner = spans_of(small, places)
            return [b for b in spans_of(big, places) if any(b[0] <= s[0] and s[1] <= b[1] for s in inner)]
        case q.IContainedBy(small, big):
            outer = spans_of(big, places)
            return [s for s in spans_of(small, places) if any(b[0] <= s[0] and s[1] <= b[1] for b in outer)]
        case q.INotContaining(big, small):
            inner = spans_of(small, places)
            return [b for b in spans_of(big, places) if not any(b[0] <= s[0] and s[1] <= b[1] for s in inner)]
    raise TypeError(f"not a source of intervals: {source}")


def _unordered(options: list[list[Span]], most: int) -> list[Span]:
    """The hulls of one interval of each part, with at most ``most`` places between them.

    For every start the parts are folded one by one into the fewest gaps for
    each end, so the work grows with the number of hulls, not of choices.
    """
    if not all(options):
        return []
    found: set[Span] = set()
    for low in sorted({s for o in options for s, _ in o}):
        # state: (hull's end, whether an interval starts at low) -> greatest length covered
        state: dict[tuple[int, bool], int] = {(low, False): 0}
        for o in options:
            after: dict[tuple[int, bool], int] = {}
            for (end, begun), covered in state.items():
                for s, e in o:
                    if s < low:
                        continue
                    key, total = (max(end, e), begun or s == low), covered + e - s
                    if total > after.get(key, -1):
                        after[key] = total
            state = after
        for (end, begun), covered in state.items():
            if begun and (most < 0 or end - low - covered <= most):
                found.add((low, end))
    return sorted(found)


def terms_of(source: q.Source) -> set[str]:
    match source:
        case q.ITerm(term):
            return {term}
        case q.IPhrase(terms):
            return set(terms)
        case q.IOr(parts) | q.IOrdered(parts, _) | q.IUnordered(parts, _):
            return set().union(*map(terms_of, parts))
        case q.IContaining(a, b) | q.IContainedBy(a, b) | q.INotContaining(a, b):
            return terms_of(a) | terms_of(b)
    raise TypeError(f"not a source of intervals: {source}")


def span_source(query: q.Query) -> q.Source:
    """A span query as a source of intervals (exclusions stay with the document)."""
    match query:
        case q.SpanTermQ(_, term) | q.TermQ(_, term):
            return q.ITerm(term)
        case q.SpanOrQ(parts):
            return q.IOr(tuple(map(span_source, parts)))
        case q.SpanNearQ(parts, slop, in_order):
            kind = q.IOrdered if in_order else q.IUnordered
            return kind(tuple(map(span_source, parts)), slop)
    raise TypeError(f"not a span query: {query}")


def span_field(query: q.Query) -> str:
    match query:
        case q.SpanTermQ(field, _) | q.TermQ(field, _):
            return field
        case q.SpanOrQ(parts) | q.SpanNearQ(parts, _, _):
            return span_field(parts[0])
        case q.SpanNotQ(include, _):
            return span_field(include)
    raise TypeError(f"not a span query: {query}")


def matching(source: q.Source) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keep documents ``(doc_id, places)`` that have an interval; places are (term, positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [
                doc
                for doc, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if spans_of(source, {p["term"]: p["positions"] for p in places})
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])

    return run
