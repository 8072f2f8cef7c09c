"""Token streams of single texts, as the index takes them.

A token is ``(term, step, start, end, type)``: ``step`` is how far its position
lies behind the one before (0 for another term at the same position), ``start``
and ``end`` are offsets of characters in the text.  A stream is a list of
tokens; a filter takes and returns one.  What a filter adds (a shingle, a
synonym, a code) follows the first token it stands for with a step of 0, so a
phrase meets it there.  Tokens that are dropped leave no gap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import regex

from . import phonetic
from .filters import delimited_parts
from .stemmers import Hunspell, Stemmer
from .tokenisers import EMAIL, TAG, TERM, URL, WORD

Token = tuple[str, int, int, int, str]
Stream = list[Token]
Source = Callable[[str], Stream]
Filter = Callable[[Stream], Stream]

_BLANKED = {i: " " for i in range(128) if not chr(i).isalnum()}
_TERM = regex.compile(TERM)


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters and decimal digits; ASCII texts avoid the regex engine."""
    return text.translate(_BLANKED).split() if text.isascii() else _TERM.findall(text)


def matches(pattern: str, kind: str = "word") -> Source:
    """Every match of a pattern is a token."""
    find = regex.compile(pattern)
    return lambda text: [(m.group(), 1, m.start(), m.end(), kind) for m in find.finditer(text) if m.end() > m.start()]


standard = matches(TERM)
whitespace = matches(r"\S+")
letter = matches(r"\p{L}+")


def keyword(text: str) -> Stream:
    return [(text, 1, 0, len(text), "word")] if text else []


_TYPED = regex.compile(rf"(?P<url>{URL})|(?P<email>{EMAIL})|(?P<tag>{TAG})|(?P<word>{WORD})")


def uax29(text: str) -> Stream:
    """Words, URLs, mail addresses, hashtags and mentions, with their types."""
    out = []
    for m in _TYPED.finditer(text):
        t, kind = m.group(), m.lastgroup
        if kind == "tag":
            kind = "hashtag" if t[0] == "#" else "mention"
        elif kind == "word" and t.isdecimal():
            kind = "number"
        out.append((t, 1, m.start(), m.end(), kind))
    return out


def chain(source: Source, *filters: Filter) -> Source:
    """A source and the filters behind it, as one source."""

    def run(text: str) -> Stream:
        tokens = source(text)
        for f in filters:
            tokens = f(tokens)
        return tokens

    return run


def each(change: Callable[[str], str]) -> Filter:
    """Change every term; an empty one is dropped."""
    return lambda tokens: [(c, *t[1:]) for t in tokens if (c := change(t[0]))]


lowercase = each(str.lower)
accent_fold = each(phonetic.fold)


def stop(words: Iterable[str]) -> Filter:
    listed = {w.lower() for w in words}
    return lambda tokens: [t for t in tokens if t[0].lower() not in listed]


def keep(words: Iterable[str]) -> Filter:
    listed = {w.lower() for w in words}
    return lambda tokens: [t for t in tokens if t[0].lower() in listed]


def of_type(types: Iterable[str], drop: bool = False) -> Filter:
    """Keep the tokens of some types, or drop them."""
    listed = set(types)
    return lambda tokens: [t for t in tokens if (t[4] in listed) != drop]


def stem(stemmer: Stemmer) -> Filter:
    known: dict[str, str] = {}

    def one(term: str) -> str:
        if term not in known:
            if len(known) > 200_000:
                known.clear()
            known[term] = stemmer(term)
        return known[term]

    return each(one)


def mark_keywords(words: Iterable[str], inner: Filter) -> Filter:
    """Apply ``inner`` to each token but those of some words."""
    listed = {w.lower() for w in words}
    return lambda tokens: [x for t in tokens for x in ([t] if t[0].lower() in listed else inner([t]))]


def _beside(make: Callable[[str], list[str]], inject: bool, kind: str) -> Filter:
    """Terms made of a term, beside it or in its place; where none is made the term stays."""

    def run(tokens: Stream) -> Stream:
        out = []
        for t in tokens:
            made = [m for m in dict.fromkeys(make(t[0])) if m and (not inject or m != t[0])]
            if inject or not made:
                out.append(t)
            out += [(m, 0 if inject or i else t[1], t[2], t[3], kind) for i, m in enumerate(made)]
        return out

    return run


def metaphone(inject: bool = True) -> Filter:
    return _beside(lambda t: [phonetic.metaphone(t)], inject, "phonetic")


def phonetic_alternates(inject: bool = True, most: int = 4) -> Filter:
    return _beside(lambda t: phonetic.name_codes(t, most), inject, "phonetic")


def hunspell(dictionary: Hunspell) -> Filter:
    """All stems of a word in its place."""
    return _beside(dictionary, False, "word")


def word_delimiter(**options) -> Filter:
    """The parts of a token share its position and offsets."""
    return _beside(lambda t: delimited_parts(t, **options), False, "word")


def hyphenated(tokens: Stream, separator: str = "-") -> Stream:
    """Join the tokens of one position."""
    out: Stream = []
    for t in tokens:
        if out and t[1] == 0:
            a = out[-1]
            out[-1] = (a[0] + separator + t[0], *a[1:3], t[3], a[4])
        else:
            out.append(t)
    return out


def unique(tokens: Stream) -> Stream:
    """A term once for each position."""
    out: Stream = []
    seen: set[str] = set()
    for t in tokens:
        if t[1]:
            seen = set()
        if t[0] not in seen:
            seen.add(t[0])
            out.append(t)
    return out


def flatten(tokens: Stream) -> Stream:
    """Every token on a position of its own."""
    return [(t[0], 1, *t[2:]) for t in tokens]


def shingles(low: int = 2, high: int = 2, unigrams: bool = True, separator: str = " ") -> Filter:
    """Runs of low..high tokens, each at the position of its first."""

    def run(tokens: Stream) -> Stream:
        out: Stream = []
        for i, t in enumerate(tokens):
            own = [t] if unigrams else []
            for k in range(low, min(high, len(tokens) - i) + 1):
                part = tokens[i : i + k]
                own.append((separator.join(p[0] for p in part), 0 if own else 1, t[2], part[-1][3], "shingle"))
            out += own
        return out

    return run


def common_grams(words: Iterable[str], separator: str = "_") -> Filter:
    """Pairs of neighbours that are both common, beside the first of them."""
    listed = {w.lower() for w in words}

    def run(tokens: Stream) -> Stream:
        out: Stream = []
        for t, after in zip(tokens, [*tokens[1:], None]):
            out.append(t)
            if after is not None and t[0].lower() in listed and after[0].lower() in listed:
                out.append((t[0] + separator + after[0], 0, t[2], after[3], "gram"))
        return out

    return run


def synonyms(table: Mapping[str, Iterable[str]]) -> Filter:
    """Replacements beside the first word of each phrase of the table; the longest phrase wins."""
    phrases = {tuple(k.lower().split()): list(v) for k, v in table.items()}
    most = max(map(len, phrases), default=0)

    def run(tokens: Stream) -> Stream:
        low = [t[0].lower() for t in tokens]
        out: Stream = []
        i = 0
        while i < len(tokens):
            n = next((n for n in range(min(most, len(low) - i), 0, -1) if tuple(low[i : i + n]) in phrases), 0)
            out.append(tokens[i])
            if n:
                end = tokens[i + n - 1][3]
                out += [(r, 0, tokens[i][2], end, "synonym") for r in phrases[tuple(low[i : i + n])]]
            out += tokens[i + 1 : i + n]
            i += n or 1
        return out

    return run


def cached(source: Source, most: int = 1000) -> Source:
    """Remember the tokens of the last texts; for collections that repeat them, such as tags and titles."""
    known: dict[str, Stream] = {}

    def run(text: str) -> Stream:
        found = known.pop(text, None)
        known[text] = found = source(text) if found is None else found
        if len(known) > most:
            known.pop(next(iter(known)))
        return list(found)

    return run


def limit(most: int, reject: bool = False) -> Filter:
    """At most so many tokens: the rest is cut off, or is an error."""

    def run(tokens: Stream) -> Stream:
        if reject and len(tokens) > most:
            raise ValueError(f"more than {most} tokens")
        return tokens[:most]

    return run


def positions(tokens: Stream) -> list[int]:
    """Where each token stands, from 0; the first one steps in any case."""
    at, out = -1, []
    for t in tokens:
        at += max(t[1], 1 if at < 0 else 0)
        out.append(at)
    return out
