"""Analysers: a tokeniser between character filters and token filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters, stemmers, streams, tokenisers
from .charfilters import CharFilter
from .stopwords import STOP_WORDS, stop_words


@dataclass(frozen=True)
class Analyser:
    """Turns a text column into ``array<string>`` of terms."""

    tokenise: tokenisers.Tokeniser
    token_filters: tuple[filters.TokenFilter, ...] = ()
    char_filters: tuple[CharFilter, ...] = ()
    #: The terms of one text, one position each, in Python; optional.  Queries and indexes use it.
    local: Callable[[str], list[str]] | None = field(default=None, compare=False)
    #: The tokens of one text with positions, offsets and types (see ``streams``); optional.
    stream: streams.Source | None = field(default=None, compare=False)

    def prepared(self, text: Column) -> Column:
        """The text after the character filters."""
        for f in self.char_filters:
            text = f(text)
        return text

    def terms(self, text: Column) -> Column:
        tokens = self.tokenise(self.prepared(text))
        for f in self.token_filters:
            tokens = f(tokens)
        return tokens

    def of(self, text: str) -> list[str]:
        """Terms of a single text (a query); a one-row job where no local form exists."""
        if self.local is not None and not self.char_filters:
            return self.local(text)
        if self.stream is not None and not self.char_filters:
            return [t[0] for t in self.stream(text)]
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        return list(spark.range(1).select(self.terms(F.lit(text)).alias("t")).first()["t"])

    def places(self, text: str) -> list[list[str]]:
        """The terms of a single text by position, those without any left out."""
        if self.stream is None or self.char_filters:
            return [[t] for t in self.of(text)]
        out: dict[int, list[str]] = {}
        tokens = self.stream(text)
        for t, at in zip(tokens, streams.positions(tokens)):
            if t[0] not in out.setdefault(at, []):
                out[at].append(t[0])
        return [out[at] for at in sorted(out)]

    def budget(self, most: int, reject: bool = False) -> Analyser:
        """At most ``most`` terms of a text: the rest is cut off, or raises an error."""
        if reject:
            over = F.concat(F.lit(f"more than {most} tokens: "), F.lit(""))
            cut = lambda t: F.when(F.size(t) <= most, t).otherwise(F.raise_error(over).cast("array<string>"))
        else:
            cut = filters.limit(most)
        own = self.stream and streams.chain(self.stream, streams.limit(most, reject))
        return Analyser(self.tokenise, (*self.token_filters, cut), self.char_filters, stream=own)


def streamed(source: streams.Source, *token_filters: streams.Filter, char_filters: tuple[CharFilter, ...] = ()) -> Analyser:
    """An analyser of a token stream, whose filters may put several terms at a position."""
    own = streams.chain(source, *token_filters)

    def run(texts):
        return pd.Series([[] if t is None else [x[0] for x in own(t)] for t in texts])

    return Analyser(lambda text: F.pandas_udf(run, "array<string>")(text), (), char_filters, stream=own)


def _local(stops: Iterable[str], stem: Callable[[str], str] | None = None, find: Callable[[str], list[str]] = streams.terms_of) -> Callable[[str], list[str]]:
    known: dict[str, str] = {}
    left_out = {w.lower() for w in stops}

    def stems(terms: list[str]) -> list[str]:
        if len(known) > 200_000:
            known.clear()
        for t in terms:
            if t not in known:
                known[t] = stem(t)
        return [known[t] for t in terms]

    def run(text: str) -> list[str]:
        kept = [low for t in find(text) if (low := t.lower()) not in left_out]
        return stems(kept) if stem else kept

    return run


def _built(tokenise: tokenisers.Tokeniser, listed: list[str], stemmer: stemmers.Stemmer | None, source: streams.Source, find) -> Analyser:
    """Split, drop stop words, lower the case, stem: as columns, as terms and as a stream."""
    columns: tuple = ((filters.stop(listed),) if listed else ()) + (filters.lowercase,) + ((filters.stem(stemmer),) if stemmer else ())
    steps = [streams.stop(listed), streams.lowercase, *([streams.stem(stemmer)] if stemmer else [])]
    return Analyser(tokenise, columns, local=_local(listed, stemmer, find), stream=streams.chain(source, *steps))


def standard(stops: list[str] | None = None) -> Analyser:
    """Letters and digits, without stop words, in lower case."""
    return _built(tokenisers.standard, STOP_WORDS["en"] if stops is None else stops, None, streams.standard, streams.terms_of)


def stemmed() -> Analyser:
    """The standard analyser and Porter's stemmer."""
    return with_stemmer(stemmers.porter)


def with_stemmer(stemmer: stemmers.Stemmer, stops: list[str] | None = None) -> Analyser:
    return _built(tokenisers.standard, STOP_WORDS["en"] if stops is None else stops, stemmer, streams.standard, streams.terms_of)


def _find(source: streams.Source) -> Callable[[str], list[str]]:
    return lambda text: [t[0] for t in source(text)]


def whitespace() -> Analyser:
    return Analyser(tokenisers.whitespace, local=str.split, stream=streams.whitespace)


def keyword() -> Analyser:
    return Analyser(tokenisers.keyword, local=_find(streams.keyword), stream=streams.keyword)


def simple() -> Analyser:
    """Letters only, in lower case."""
    return _built(tokenisers.letter, [], None, streams.letter, _find(streams.letter))


def icu() -> Analyser:
    own = streams.matches(tokenisers.WORD)
    return _built(tokenisers.icu, [], None, own, _find(own))


def language(tag: str) -> Analyser:
    """The analyser of a language tag: its stop words and stemmer, bigrams for Chinese, Japanese and Korean."""
    base = tag.lower().split("-")[0].split("_")[0]
    if base in ("zh", "ja", "ko"):
        return Analyser(tokenisers.cjk_bigram, (filters.lowercase, filters.stop(stop_words(base))))
    return with_stemmer(stemmers.stemmer(base), stop_words(base))


def by_language(text: Column, tag: Column, tags: list[str]) -> Column:
    """Each row analysed in its own language; other tags as standard."""
    base = F.regexp_extract(F.lower(F.coalesce(tag, F.lit(""))), "^[a-z]+", 0)
    out = standard().terms(text)
    for t in tags:
        out = F.when(base == t, language(t).terms(text)).otherwise(out)
    return out


def analyse(df: DataFrame, key: str, text: str, analyser: Analyser) -> DataFrame:
    """``(doc_id, pos, term)`` of a table."""
    return df.select(F.col(key).alias("doc_id"), F.posexplode(analyser.terms(F.col(text))).alias("pos", "term"))
