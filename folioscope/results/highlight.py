"""Snippets of texts around the terms of a query."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..analysis.stopwords import STOP_WORDS
from ..index.build import Index
from ..query import nodes as q

_BREAK = re.compile(r"[.!?;\n—]")


def query_terms(query: q.Query, field: str | None = None) -> dict[str, set[str]]:
    """Terms by field that a query asks for; what it excludes is left out."""
    out: dict[str, set[str]] = defaultdict(set)

    def walk(x: q.Query) -> None:
        match x:
            case q.TermQ(f, t) | q.SpanTermQ(f, t) | q.FuzzyQ(f, t, _, _) | q.PrefixQ(f, t) | q.WildcardQ(f, t):
                out[f].add(t)
            case q.TermsQ(f, ts) | q.PhraseQ(f, ts, _):
                out[f].update(ts)
            case q.MultiPhraseQ(f, groups, _, _):
                out[f].update(t for g in groups for t in g)
            case q.CombinedQ(fs, ts):
                for f in fs:
                    out[f].update(ts)
            case q.Bool(must, should, _):
                for c in (*must, *should):
                    walk(c)
            case q.DisMaxQ(parts, _) | q.RrfQ(parts) | q.SpanNearQ(parts, _, _) | q.SpanOrQ(parts):
                for p in parts:
                    walk(p)
            case q.ConstantQ(inner, _) | q.FunctionQ(inner, _, _) | q.SpanNotQ(inner, _):
                walk(inner)

    walk(query)
    return {f: t for f, t in out.items() if field is None or f == field}


def phrases(query: q.Query) -> list[tuple[str, tuple[str, ...]]]:
    """Phrases of a query, with their fields."""
    match query:
        case q.PhraseQ(f, terms, _):
            return [(f, terms)]
        case q.Bool(must, should, _):
            return [p for c in (*must, *should) for p in phrases(c)]
        case q.ConstantQ(inner, _) | q.FunctionQ(inner, _, _):
            return phrases(inner)
    return []


def snippet(text: str, terms: list[str], size: int = 200, before: str = "<b>", after: str = "</b>", sentences: bool = False, whole: list[tuple[str, ...]] = ()) -> str:
    """The window with most matches; the first of equals.

    Matches are whole words in any case; stop words count for nothing.  A
    window starts a quarter of its size before a match, or with ``sentences``
    after the last end of a sentence there.  Of phrases in ``whole`` only words
    that stand together count.
    """
    wanted = sorted({t for t in terms if t and t.lower() not in STOP_WORDS["en"]}, key=lambda t: (-len(t), t))
    runs = [r"\W+".join(map(re.escape, p)) for p in whole]
    single = [re.escape(t) for t in wanted if not any(t in p for p in whole)]
    parts = runs + single
    found = []
    if text and parts:
        found = [m.span() for m in re.finditer(rf"(?<!\w)(?:{'|'.join(parts)})(?!\w)", text, re.I)]
    return marked(text, found, size, before, after, sentences)


def marked(text: str, found: list[tuple[int, int]], size: int = 200, before: str = "<b>", after: str = "</b>", sentences: bool = False) -> str:
    """The window with most of the spans ``found`` (ascending), these marked; the text's beginning where there is none."""
    if not found:
        return text if len(text) <= size else text[:size] + "..."
    best, at, end = 0, 0, min(len(text), size)
    for i, (s, _) in enumerate(found):
        start = max(0, s - size // 4)
        if sentences:
            cuts = [m.end() for m in _BREAK.finditer(text, start, s)]
            start = cuts[-1] if cuts else start
        stop = min(len(text), start + size)
        score = sum(1 for _, b in itertools.takewhile(lambda x: x[0] < stop, found[i:]) if b <= stop)
        if score > best:
            best, at, end = score, start, stop
    out, last = ["..." if at else ""], at
    for a, b in found:
        if a >= max(at, last) and b <= end:
            out += [text[last:a], before, text[a:b], after]
            last = b
    return "".join([*out, text[last:end], "..." if end < len(text) else ""])


def highlight(text: Column, query: q.Query, field: str, **options) -> Column:
    """Snippets of a text column; null texts give null."""
    terms = sorted(query_terms(query, field).get(field, set()))
    whole = [p for f, p in phrases(query) if f == field] if options.pop("as_phrases", False) else []

    def run(texts):
        return pd.Series([None if t is None else snippet(t, terms, whole=whole, **options) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def _leaves(query: q.Query, field: str) -> list[q.Query]:
    """The leaves of a query that ask for terms of a field; what it excludes is left out."""
    match query:
        case q.Bool(must, should, _):
            return [x for c in (*must, *should) for x in _leaves(c, field)]
        case q.DisMaxQ(parts, _) | q.RrfQ(parts) | q.SpanNearQ(parts, _, _) | q.SpanOrQ(parts):
            return [x for c in parts for x in _leaves(c, field)]
        case q.ConstantQ(inner, _) | q.FunctionQ(inner, _, _) | q.SpanNotQ(inner, _):
            return _leaves(inner, field)
        case q.CombinedQ(fields, terms):
            return [q.TermsQ(field, terms)] if field in fields else []
    return [query] if getattr(query, "field", None) == field else []


def _asks(leaf: q.Query) -> Column:
    """Whether a posting's term is one that a leaf asks for."""
    term = F.col("term")
    match leaf:
        case q.TermQ(_, t) | q.SpanTermQ(_, t):
            return term == t
        case q.TermsQ(_, ts) | q.PhraseQ(_, ts, _):
            return term.isin(list(ts))
        case q.MultiPhraseQ(_, groups, _, _):
            return term.isin(sorted({t for g in groups for t in g}))
        case q.PrefixQ(_, prefix):
            return term.startswith(prefix)
        case q.WildcardQ(_, pattern):
            return term.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")
        case q.RegexpQ(_, pattern):
            return term.rlike(pattern)
        case q.FuzzyQ(_, t, edits, _):
            return F.levenshtein(term, F.lit(t), edits).between(0, edits)
    return F.lit(False)


def term_vectors(index: Index, field: str, hits: DataFrame | None = None) -> DataFrame:
    """``(doc_id, term, tf, positions, starts, ends)`` of a field, of all documents or of hits."""
    rows = index.postings.where(F.col("field") == field).select("doc_id", "term", "tf", "positions", "starts", "ends")
    return rows if hits is None else rows.join(hits.select("doc_id"), "doc_id", "left_semi")


def _whole(places: list, runs: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """Spans of the places that count: of a phrase's terms only those that stand in a row."""
    at: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
    for p in places:
        for i, s, e in zip(p["positions"], p["starts"], p["ends"]):
            at[p["term"]][i] = (int(s), int(e))
    spans = set()
    for run in runs:
        for i in at[run[0]]:
            if all(i + k in at[t] for k, t in enumerate(run)):
                spans.add((at[run[0]][i][0], at[run[-1]][i + len(run) - 1][1]))
    inside = {t for run in runs for t in run}
    return sorted(spans | {s for t, own in at.items() if t not in inside for s in own.values()})


def highlight_postings(hits: DataFrame, index: Index, query: q.Query, field: str, size: int = 200, as_phrases: bool = False, **options) -> DataFrame:
    """``(doc_id, snippet)`` of hits, from the offsets that the postings keep.

    What the query matched is marked as it stands in the text, so stemmed,
    folded or synonymous terms are marked too.  Documents whose field has no
    offsets (or no match in this field) have the text matched anew, as
    :func:`highlight` does.  With ``as_phrases`` words of a phrase count only
    in a row.  Null texts give null.
    """
    leaves = _leaves(query, field)
    where = F.lit(False)
    for leaf in leaves:
        where = where | _asks(leaf)
    runs = [x.terms for x in leaves if isinstance(x, q.PhraseQ) and len(x.terms) > 1] if as_phrases else []
    terms = sorted(query_terms(query, field).get(field, set()))
    asked = index.postings.where((F.col("field") == field) & where & F.col("starts").isNotNull()).join(hits.select("doc_id"), "doc_id", "left_semi")
    # as many rows of a document as the query has terms
    places = asked.groupBy("doc_id").agg(F.collect_list(F.struct("term", "positions", "starts", "ends")).alias("places"))
    rows = hits.select("doc_id").join(index.docs.select("doc_id", F.col(field).alias("_text")), "doc_id").join(places, "doc_id", "left")

    def run(texts, found):
        out = []
        for t, p in zip(texts, found):
            if t is None:
                out.append(None)
            elif p is None or not len(p):
                out.append(snippet(t, terms, size, whole=runs, **options))
            else:
                out.append(marked(t, _whole(list(p), runs), size, **options))
        return pd.Series(out, dtype=object)

    return rows.select("doc_id", F.pandas_udf(run, "string")("_text", "places").alias("snippet"))
