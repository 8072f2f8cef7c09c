"""Changes to token arrays: functions from ``array<string>`` to ``array<string>``.

A token's place in the array is its position.  Filters that put several tokens
at one position return ``array<struct<term, pos>>`` and say so.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phonetic
from .stemmers import Hunspell, Stemmer

TokenFilter = Callable[[Column], Column]


def _each(f: Callable[[Column], Column]) -> TokenFilter:
    return lambda tokens: F.transform(tokens, f)


def _words(words: Iterable[str]) -> list[str]:
    return sorted({w.lower() for w in words})


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def stop(words: Iterable[str]) -> TokenFilter:
    """Drop words, in any case; positions close up."""
    listed = _words(words)
    return lambda tokens: F.filter(tokens, lambda t: ~F.lower(t).isin(listed)) if listed else tokens


def keep(words: Iterable[str]) -> TokenFilter:
    listed = _words(words)
    return lambda tokens: F.filter(tokens, lambda t: F.lower(t).isin(listed))


def length(low: int, high: int) -> TokenFilter:
    return lambda tokens: F.filter(tokens, lambda t: F.length(t).between(low, high))


def truncate(n: int) -> TokenFilter:
    return _each(lambda t: F.substring(t, 1, n))


def limit(n: int) -> TokenFilter:
    return lambda tokens: F.slice(tokens, 1, n)


def accent_fold(tokens: Column) -> Column:
    """Letters of any script without the marks that canonical decomposition parts from them."""
    return _mapped(lambda t: [t if t.isascii() else phonetic.fold(t)], "array<string>")(tokens)


#: Zeros of all scripts whose digits fit a character of 16 bits, from the Unicode database.
_ZEROS = [c for c in range(0x80, 0x10000) if unicodedata.decimal(chr(c), None) == 0]


def decimal_digits(tokens: Column) -> Column:
    """Decimal digits of any script as ASCII digits."""
    foreign = "".join(chr(z + i) for z in _ZEROS for i in range(10))
    return F.transform(tokens, lambda t: F.translate(t, foreign, "0123456789" * len(_ZEROS)))


def reverse(tokens: Column) -> Column:
    return F.transform(tokens, F.reverse)


# French articles before an apostrophe.
ARTICLES = ["l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu"]


def elision(articles: Iterable[str] = ARTICLES) -> TokenFilter:
    """Drop an article and its apostrophe from the front of a token."""
    listed = "|".join(sorted(map(re.escape, articles), key=len, reverse=True))
    return _each(lambda t: F.regexp_replace(t, rf"^(?i:{listed})['’]", ""))


def classic(tokens: Column) -> Column:
    """Drop a possessive ending, and the points of an acronym."""
    clean = lambda t: F.when(t.rlike(r"^(?:\p{L}\.){2,}$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(
        F.regexp_replace(t, r"['’][sS]$", "")
    )
    return F.transform(tokens, clean)


def pattern_replace(pattern: str, replacement: str, first: bool = False) -> TokenFilter:
    if first:
        return _each(lambda t: F.regexp_replace(t, f"^(.*?)(?:{pattern})", f"$1{replacement}"))
    return _each(lambda t: F.regexp_replace(t, pattern, replacement))


def of_type(types: Iterable[str], drop: bool = False) -> Callable[[Column], Column]:
    """From ``array<struct<term, type>>``: the terms of some types, or of all others."""
    listed = list(types)
    return lambda typed: F.transform(
        F.filter(typed, lambda t: ~t["type"].isin(listed) if drop else t["type"].isin(listed)), lambda t: t["term"]
    )


def positioned(tokens: Column) -> Column:
    """``array<struct<term, pos>>``, positions from 0."""
    return F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))


def unique(placed: Column) -> Column:
    """Repeats at one position once; takes and returns ``array<struct<term, pos>>``."""
    return F.array_distinct(placed)


def mark_keywords(words: Iterable[str], inner: TokenFilter) -> TokenFilter:
    """Apply ``inner``, but leave some words alone."""
    listed = _words(words)
    one = lambda t: F.when(F.lower(t).isin(listed), t).otherwise(F.get(inner(F.array(t)), F.lit(0)))
    return _each(one)


def shingles(low: int = 2, high: int = 2, unigrams: bool = True, separator: str = " ") -> TokenFilter:
    """Runs of low..high neighbouring tokens, after the single ones."""

    def runs(tokens: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - k + 1)
        joined = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), separator))
        return F.when(F.size(tokens) >= k, joined).otherwise(F.array().cast("array<string>"))

    return lambda tokens: F.concat(*([tokens] if unigrams else []), *[runs(tokens, k) for k in range(low, high + 1)])


def common_grams(words: Iterable[str], separator: str = "_") -> TokenFilter:
    """Pairs of neighbours that are both common, after the tokens."""
    listed = _words(words)

    def apply(tokens: Column) -> Column:
        both = lambda a, b: F.when(a.isin(listed) & b.isin(listed), F.concat(a, F.lit(separator), b))
        pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), both)
        return F.concat(tokens, F.array_compact(pairs))

    return apply


def synonyms(table: Mapping[str, Iterable[str]]) -> Callable[[Column], Column]:
    """Add replacements where a phrase of the table starts.

    Keys are phrases with single blanks; the longest that matches at a place
    wins and its words are not looked at again.  Tokens stay.  Returns
    ``array<struct<term, pos>>`` with a replacement at its phrase's place.
    """
    phrases = {tuple(k.lower().split()): list(v) for k, v in table.items()}
    most = max(map(len, phrases), default=0)

    def add(tokens: list[str]) -> list[dict]:
        out = [{"term": t, "pos": i} for i, t in enumerate(tokens)]
        low = [t.lower() for t in tokens]
        i = 0
        while i < len(low):
            k = next((k for k in range(min(most, len(low) - i), 0, -1) if tuple(low[i : i + k]) in phrases), 0)
            out += [{"term": r, "pos": i} for r in phrases.get(tuple(low[i : i + k]), [])] if k else []
            i += k or 1
        return sorted(out, key=lambda x: x["pos"])

    def run(batch):
        return pd.Series([[] if t is None else add(list(t)) for t in batch])

    return lambda tokens: F.pandas_udf(run, "array<struct<term string, pos int>>")(tokens)


def flatten_graph(placed: Column) -> Column:
    """The terms of ``array<struct<term, pos>>`` in order of position."""
    return F.transform(F.sort_array(F.transform(placed, lambda t: F.struct(t["pos"], t["term"]))), lambda t: t["term"])


def hyphenated(placed: Column, separator: str = "-") -> Column:
    """Join the terms of one position; takes and returns ``array<struct<term, pos>>``, by position."""

    def run(batch):
        rows = []
        for tokens in batch:
            own: dict[int, list[str]] = {}
            for t in [] if tokens is None else tokens:
                own.setdefault(int(t["pos"]), []).append(t["term"])
            rows.append([{"term": separator.join(own[i]), "pos": i} for i in sorted(own)])
        return pd.Series(rows)

    return F.pandas_udf(run, _PLACED)(placed)


# Characters that part the words of a token.
DELIMITERS = "-_./\\&+#,;:"


def delimited_parts(
    token: str,
    words: bool = True,
    numbers: bool = True,
    join_words: bool = False,
    join_numbers: bool = False,
    join_all: bool = False,
    by_case: bool = True,
    by_digit: bool = True,
    possessive: bool = True,
    original: bool = False,
    delimiters: str = DELIMITERS,
) -> list[str]:
    """Parts of a token at delimiters and at changes of case and of digits."""
    body = re.sub(r"'[sS]?$", "", token) if possessive and len(token) > 1 else token
    cut = "".join(" " if c in delimiters else c for c in body)
    if by_digit:
        cut = re.sub(r"(?<=\d)(?=[^\d\s])|(?<=[^\d\s])(?=\d)", " ", cut)
    if by_case:
        marks = [
            i
            for i in range(1, len(cut))
            if (cut[i - 1].islower() and cut[i].isupper()) or (i > 1 and cut[i].islower() and cut[i - 1].isupper() and cut[i - 2].isupper())
        ]
        for i in reversed(marks):
            at = i if cut[i].isupper() else i - 1
            cut = cut[:at] + " " + cut[at:]
    parts = cut.split()
    number = [p[0].isdigit() for p in parts]
    out = [p for p, n in zip(parts, number) if (numbers if n else words)]
    for wanted, chosen in (
        (join_words, [p for p, n in zip(parts, number) if not n]),
        (join_numbers, [p for p, n in zip(parts, number) if n]),
    ):
        if wanted and len(chosen) > 1:
            out.append("".join(chosen))
    if join_all and parts:
        out.append("".join(parts))
    if original or not out:
        out.append(token)
    return out


def word_delimiter(**options) -> Callable[[Column], Column]:
    """``array<struct<term, pos>>``: the parts of a token share its position."""

    def run(batch):
        return pd.Series(
            [[] if t is None else [{"term": p, "pos": i} for i, x in enumerate(t) for p in delimited_parts(x, **options)] for t in batch]
        )

    return lambda tokens: F.pandas_udf(run, "array<struct<term string, pos int>>")(tokens)


def _mapped(f: Callable[[str], list[str]], kind: str) -> Callable[[Column], Column]:
    """Apply ``f`` to each token; a worker computes each distinct word once."""

    def run(batch):
        known: dict[str, list[str]] = {}
        out = []
        for tokens in batch:
            row = []
            for i, t in enumerate([] if tokens is None else tokens):
                if t not in known:
                    known[t] = f(t)
                row += known[t] if kind == "array<string>" else [{"term": x, "pos": i} for x in known[t]]
            out.append(row)
        return pd.Series(out)

    return lambda tokens: F.pandas_udf(run, kind)(tokens)


_PLACED = "array<struct<term string, pos int>>"


def stem(stemmer: Stemmer) -> TokenFilter:
    return _mapped(lambda t: [stemmer(t)], "array<string>")


def hunspell(dictionary: Hunspell) -> Callable[[Column], Column]:
    """All stems of a word at its position (``array<struct<term, pos>>``)."""
    return _mapped(lambda t: dictionary(t), _PLACED)


def metaphone(inject: bool = True) -> Callable[[Column], Column]:
    """Codes beside the words, or in their place (``array<struct<term, pos>>``)."""

    def codes(t: str) -> list[str]:
        code = phonetic.metaphone(t)
        return [t, *([code] if code and code != t else [])] if inject else [code or t]

    return _mapped(codes, _PLACED)


def phonetic_alternates(inject: bool = True, most: int = 4) -> Callable[[Column], Column]:
    """Codes of spelling variants (``array<struct<term, pos>>``)."""

    def codes(t: str) -> list[str]:
        found = phonetic.name_codes(t, most)
        return [t, *[c for c in found if c != t]] if inject else found or [t]

    return _mapped(codes, _PLACED)
