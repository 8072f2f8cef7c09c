"""Splitting texts into tokens: functions from Column to ``array<string>``.

All but the wiki and Thai tokenisers are built-in expressions.  A null text has
no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Tokeniser = Callable[[Column], Column]

TERM = r"[\p{L}\p{Nd}]+"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
URL = r"(?:https?|ftp)://[^\s<>\"]+[^\s<>\".,;:!?)\]]"
EMAIL = r"[\p{L}\p{Nd}._%+-]+@[\p{L}\p{Nd}-]+(?:\.[\p{L}\p{Nd}-]+)+"
TAG = r"[#@][\p{L}\p{Nd}_]+"
WORD = r"[\p{L}\p{Nd}\p{M}]+(?:['’_.-][\p{L}\p{Nd}\p{M}]+)*"


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def standard(text: Column) -> Column:
    """Maximal runs of letters and decimal digits."""
    return _all(text, TERM)


def whitespace(text: Column) -> Column:
    return _all(text, r"\S+")


def letter(text: Column) -> Column:
    return _all(text, r"\p{L}+")


def keyword(text: Column) -> Column:
    """The whole text as one token."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))


def pattern(regex: str) -> Tokeniser:
    """Each non-empty match of a regular expression."""
    return lambda text: F.filter(_all(text, regex), lambda t: t != "")


def _grams(word: Column, low: int, high: int) -> Column:
    """Substrings of low..high characters, by start and then by length."""
    n = F.length(word)
    starts = F.when(n >= low, F.sequence(F.lit(1), n - low + 1)).otherwise(F.array().cast("array<int>"))
    of = lambda s: F.transform(
        F.sequence(F.lit(low), F.least(F.lit(high), n - s + 1)), lambda k: F.substring(word, s, k)
    )
    return F.flatten(F.transform(starts, of))


def ngram(low: int, high: int, by_word: bool = False) -> Tokeniser:
    """All substrings of the text, or of each word of it."""
    if by_word:
        return lambda text: F.flatten(F.transform(whitespace(text), lambda w: _grams(w, low, high)))
    return lambda text: F.coalesce(_grams(text, low, high), F.array().cast("array<string>"))


def edge_ngram(low: int, high: int) -> Tokeniser:
    """Prefixes of each word."""

    def prefixes(word: Column) -> Column:
        n = F.least(F.lit(high), F.length(word))
        return F.when(n >= low, F.transform(F.sequence(F.lit(low), n), lambda k: F.substring(word, F.lit(1), k))).otherwise(
            F.array().cast("array<string>")
        )

    return lambda text: F.flatten(F.transform(whitespace(text), prefixes))


def cjk_bigram(text: Column) -> Column:
    """Overlapping pairs of Han, kana and Hangul; other letters and digits in runs."""
    runs = _all(text, rf"[{_CJK}]+|(?:(?![{_CJK}])[\p{{L}}\p{{Nd}}])+")

    def split(run: Column) -> Column:
        wide = run.rlike(rf"^[{_CJK}]") & (F.length(run) > 1)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(wide, pairs).otherwise(F.array(run))

    return F.flatten(F.transform(runs, split))


def icu(text: Column) -> Column:
    """Words with inner apostrophes, hyphens, points and underscores."""
    return _all(text, WORD)


def uax29(text: Column) -> Column:
    """Words, with URLs, mail addresses, hashtags and mentions kept whole."""
    return _all(text, f"{URL}|{EMAIL}|{TAG}|{WORD}")


def uax29_typed(text: Column) -> Column:
    """``array<struct<term, type>>`` of :func:`uax29`."""
    kind = lambda t: (
        F.when(t.rlike(f"^(?:{URL})$"), "url").when(t.rlike(f"^(?:{EMAIL})$"), "email").when(t.startswith("#"), "hashtag")
        .when(t.startswith("@"), "mention").when(t.rlike(r"^\p{Nd}+$"), "number").otherwise("word")
    )
    return F.transform(uax29(text), lambda t: F.struct(t.alias("term"), kind(t).alias("type")))


# Wiki markup, in order of priority, and the type of the words it holds.
WIKI = [
    ("heading", r"={2,6}\s*(.+?)\s*={2,6}"),
    ("reference", r"<ref[^>]*>(.*?)</ref>"),
    ("bold", r"'''(.+?)'''"),
    ("italic", r"''(.+?)''"),
    ("category", r"\[\[Category:([^\]|]+)(?:\|[^\]]*)?\]\]"),
    ("link", r"\[\[(?:[^\]|]*\|)?([^\]|]+)\]\]"),
    ("external", r"\[(?:https?|ftp)://\S+\s+([^\]]+)\]"),
]


def wiki_tokens(text: str) -> list[dict[str, str]]:
    """Typed words of wiki text; markup is read from the labels."""
    whole = re.compile("|".join(f"(?P<{n}>{p})" for n, p in WIKI), re.S)
    word = re.compile(r"(?:https?|ftp)://\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\w+(?:['’.-]\w+)*")
    out: list[dict[str, str]] = []

    def plain(part: str, kind: str) -> None:
        out.extend({"term": w, "type": kind} for w in word.findall(part))

    at = 0
    for m in whole.finditer(text):
        plain(text[at : m.start()], "word")
        kind = m.lastgroup if m.lastgroup in dict(WIKI) else next(n for n, _ in WIKI if m.group(n))
        plain(re.fullmatch(dict(WIKI)[kind], m.group(), re.S).group(1), kind)
        at = m.end()
    plain(text[at:], "word")
    return out


def mediawiki_typed(text: Column) -> Column:
    """``array<struct<term, type>>`` of wiki text."""

    def run(texts):
        return texts.map(lambda t: [] if t is None else wiki_tokens(t))

    return F.pandas_udf(run, "array<struct<term string, type string>>")(text)


def mediawiki(text: Column) -> Column:
    return F.transform(mediawiki_typed(text), lambda t: t["term"])


_THAI = "฀-๿"
_MARKS = "ัิ-ฺ็-๎"


def thai(lexicon: Iterable[str]) -> Tokeniser:
    """Longest words of a lexicon; what it lacks in clusters of a base and its marks."""
    words = {w.strip() for w in lexicon if w.strip()}
    longest = max(map(len, words), default=1)
    cluster = re.compile(f"[{_THAI}][{_MARKS}]*")
    parts = re.compile(rf"[{_THAI}]+|[^\W_]+")

    def split(text: str) -> list[str]:
        out: list[str] = []
        for run in parts.findall(text):
            if not re.match(f"[{_THAI}]", run):
                out.append(run)
                continue
            at = 0
            while at < len(run):
                n = next((k for k in range(min(longest, len(run) - at), 0, -1) if run[at : at + k] in words), 0)
                piece = run[at : at + n] if n else cluster.match(run, at).group()
                out.append(piece)
                at += len(piece)
        return out

    def run(texts):
        return pd.Series([[] if t is None else split(t) for t in texts])

    return lambda text: F.pandas_udf(run, "array<string>")(text)
