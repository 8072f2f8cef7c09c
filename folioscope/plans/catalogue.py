"""Queries over the test tables, one or more for every operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..analysis import analyser as an
from ..analysis import charfilters, filters, stemmers, streams, tokenisers
from ..functions import geo, similarity
from ..functions import vectors as vec
from ..index import build as ix
from ..index import maintain
from ..index.schema import ENCODERS, FieldSpec, Schema
from ..operators import vector_index
from ..query import nodes as q
from ..query.collection import Collection
from ..query.fields import Fields
from ..query.parser import Parser, QueryError
from ..results import collect, highlight, suggest
from ..results.cache import QueryCache
from ..runtime import shared_dir, spread, table
from ..sources import json as js
from .compile import Searcher

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_HELD: dict[tuple[str, str, str], object] = {}

TEXT, SOURCE, TITLE = FieldSpec("text"), FieldSpec("source", kind="string"), FieldSpec("title")


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _once(spark: SparkSession, sf: str, name: str, make: Callable[[], ix.Index]) -> ix.Index:
    """An index, built once for a session and a folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _HELD:
        _HELD[key] = make().staged().cached()
    return _HELD[key]


def documents_index(spark: SparkSession, sf: str) -> ix.Index:
    return _once(spark, sf, "documents", lambda: ix.build(table(spark, sf, "documents"), [TEXT, SOURCE, TITLE]))


def _docs_only(docs: DataFrame) -> Searcher:
    """A searcher for columns alone."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], ix._POSTINGS)
    stats = ix.term_stats_of(none)
    return Searcher(ix.Index(docs, none, stats, ix.corpus_stats_of(docs, stats, ["text"]), {}))


def _search(spark: SparkSession, sf: str, model: similarity.Similarity | None = None) -> Searcher:
    return Searcher(documents_index(spark, sf), model)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round(F.col("score").cast("double"), 6).alias("score"))


def _simple(name: str, make: Callable[[], q.Query]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(_search(spark, sf).hits(make()))

    run.__name__ = name
    query(run)


T = lambda t, **k: q.TermQ("text", t, **k)

_PLAIN: dict[str, q.Query] = {
    "term": T("river"),
    "term_boosted": T("river", boost=2.5),
    "term_in_string_field": q.TermQ("source", "ferry_wire"),
    "terms_in_set": q.TermsQ("text", ("river", "harbour", "kettle")),
    "term_range": q.TermRangeQ("text", "rain", "rams", True, False),
    "prefix": q.PrefixQ("text", "harb"),
    "wildcard": q.WildcardQ("text", "st?r*m"),
    "wildcard_suffix": q.WildcardQ("text", "*spring"),
    "regexp": q.RegexpQ("text", "^har.*(our|row)$"),
    "fuzzy": q.FuzzyQ("text", "rivr", 2),
    "fuzzy_expansions": q.FuzzyQ("text", "stane", 2, 5),
    "match_all": q.AllQ(boost=0.5),
    "match_none": q.NoneQ(),
    "exists_text": q.ExistsQ("text"),
    "exists_column": q.ExistsQ("lang"),
    "phrase": q.PhraseQ("text", ("two", "weeks")),
    "phrase_of_three": q.PhraseQ("text", ("two", "weeks", "later")),
    "phrase_slop": q.PhraseQ("text", ("weeks", "two"), 2),
    "multi_phrase": q.MultiPhraseQ("text", (("two", "three"), ("weeks", "men"))),
    "multi_phrase_slop": q.MultiPhraseQ("text", (("nobody", "someone"), ("field", "harbour")), slop=4),
    "span_term": q.SpanTermQ("text", "kettle"),
    "span_near_ordered": q.SpanNearQ((q.SpanTermQ("text", "nobody"), q.SpanTermQ("text", "than")), 6, True),
    "span_near_unordered": q.SpanNearQ((q.SpanTermQ("text", "field"), q.SpanTermQ("text", "old")), 3, False),
    "span_or": q.SpanOrQ((q.SpanTermQ("text", "river"), q.SpanTermQ("text", "harbour"))),
    "span_not": q.SpanNotQ(q.SpanTermQ("text", "river"), q.SpanTermQ("text", "kettle")),
    "intervals_phrase": q.IntervalsQ("text", q.IPhrase(("two", "weeks"))),
    "intervals_or": q.IntervalsQ("text", q.IOr((q.ITerm("river"), q.ITerm("kettle")))),
    "intervals_ordered": q.IntervalsQ("text", q.IOrdered((q.ITerm("nobody"), q.ITerm("than")), 5)),
    "intervals_unordered": q.IntervalsQ("text", q.IUnordered((q.ITerm("field"), q.ITerm("old")), 4)),
    "intervals_containing": q.IntervalsQ("text", q.IContaining(q.IOrdered((q.ITerm("two"), q.ITerm("later")), 3), q.ITerm("weeks"))),
    "intervals_contained_by": q.IntervalsQ("text", q.IContainedBy(q.ITerm("weeks"), q.IOrdered((q.ITerm("two"), q.ITerm("later")), 3))),
    "intervals_not_containing": q.IntervalsQ("text", q.INotContaining(q.IOrdered((q.ITerm("two"), q.ITerm("men")), 4), q.ITerm("weeks"))),
    "bool_must": q.and_(T("river"), T("weeks")),
    "bool_should": q.or_(T("river"), T("harbour"), T("kettle", boost=2.0)),
    "bool_mixed": q.Bool(must=(T("weeks"),), should=(T("river"), q.PrefixQ("text", "harb")), must_not=(T("kettle"),)),
    "bool_must_not_only": ~T("weeks"),
    "bool_least_should": q.or_(T("river"), T("weeks"), T("nobody"), least=2),
    "bool_nested": (T("river") | T("harbour")) & ~q.PhraseQ("text", ("two", "weeks")),
    "constant_score": q.ConstantQ(T("river"), 3.0),
    "dis_max": q.DisMaxQ((T("river"), T("harbour"), T("weeks")), 0.3),
    "function_score_multiply": q.FunctionQ(T("river"), "n_chars", "multiply"),
    "function_score_replace": q.FunctionQ(T("river"), "n_chars", "replace"),
    "function_score_sum": q.FunctionQ(T("river"), "n_chars", "sum"),
    "function_score_max": q.FunctionQ(T("river"), "n_chars", "max"),
    "combined_fields": q.CombinedQ(("text", "title"), ("river", "harbour", "kettle"), 1, (1.0, 3.0)),
    "combined_fields_least_two": q.CombinedQ(("text", "title"), ("river", "weeks", "nobody"), 2),
    "more_like_this": q.LikeQ(7, ("text",), min_df=2, most=10),
}
for _name, _q in _PLAIN.items():
    _simple(_name, lambda x=_q: x)


def _with_model(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(_search(spark, sf, similarity.SIMILARITIES[name]()).hits(q.or_(T("river"), T("harbour"))))

    run.__name__ = f"similarity_{name}"
    query(run)


for _name in similarity.SIMILARITIES:
    _with_model(_name)


@query
def flagship_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of a mixed query, with their sources."""
    s = _search(spark, sf)
    found = Parser("text").parse('+weeks river^2 "two weeks"~1 harb* -kettle')
    return collect.fetch(_rounded(s.search(found, 10)), s.index.docs, ["source"])


@query
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_search(spark, sf).hits(q.RrfQ((T("river"), q.PrefixQ("text", "harb")), 60, 20)))


@query
def parsed_query(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_search(spark, sf).hits(Parser("text").parse('+(river harbour) "two weeks" -title:river')))


@query
def batch_search(spark: SparkSession, sf: str) -> DataFrame:
    """The three best documents for each title's terms, one pass for all titles; only their terms are indexed."""
    docs = table(spark, sf, "documents")
    asked = docs.where("doc_id is not null and title is not null").select(
        F.col("doc_id").alias("query_id"), F.explode(an.standard().terms(F.col("title"))).alias("term")
    )
    key = (spark.sparkContext.applicationId, sf, "titles")
    if key not in _HELD:
        _HELD[key] = ix.narrowed(docs, TEXT, asked)
    return Searcher(_HELD[key]).search_many(asked, "text", 3).select("query_id", "doc_id", F.round("score", 6).alias("score"))


# -- columns


@query
def range_double(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "doc_id")
    return _rounded(_docs_only(part).hits(q.RangeQ("p_retailprice", 950.0, 1100.0)))


@query
def range_int64(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id")
    return _rounded(_docs_only(orders).hits(q.RangeQ("o_custkey", 100, 300, boost=1.5)))


@query
def points_int64(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id")
    return _rounded(_docs_only(orders).hits(q.PointsQ("o_custkey", (7, 70, 700))))


@query
def points_double(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_quantity").alias("most"))
    return _rounded(_docs_only(line).hits(q.PointsQ("most", (11.0, 13.0))))


@query
def range_many_valued(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with any line of a quantity in range."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("l_quantity").alias("quantities"))
    return _rounded(_docs_only(line).hits(q.RangeQ("quantities", 49.0, 50.0)))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with coordinates derived from their keys."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("doc_id"), "c_nationkey",
        ((key * 37) % 1700 / 10.0 - 85.0).alias("at_lat"), ((key * 91) % 3590 / 10.0 - 179.5).alias("at_lon"),
    )


@query
def geo_box(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_docs_only(_places(spark, sf)).hits(q.BoxQ("at", -20.0, -40.0, 35.5, 60.0)))


@query
def geo_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_docs_only(_places(spark, sf)).hits(q.NearQ("at", 48.2, 16.4, 1_500_000.0)))


@query
def geo_encoding(spark: SparkSession, sf: str) -> DataFrame:
    p = _places(spark, sf)
    return p.select("doc_id", geo.encode(F.col("at_lat"), 180.0).alias("lat_code"), geo.encode(F.col("at_lon"), 360.0).alias("lon_code"))


@query
def block_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a line of more than 49 pieces."""
    line = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.col("l_orderkey").alias("parent_id"), "l_quantity"
    )
    return _rounded(_docs_only(line).hits(q.ParentQ(q.RangeQ("l_quantity", 49.5, 1e9))))


# -- vectors


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")


_TARGET = tuple(((i * 37) % 19 - 9) / 9.0 for i in range(64))


@query
def vector_cosine(spark: SparkSession, sf: str) -> DataFrame:
    target = F.array(*[F.lit(x) for x in _TARGET])
    return _vectors(spark, sf).select("doc_id", F.round(vec.cosine(F.col("embedding"), target), 6).alias("score"))


@query
def vector_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_docs_only(_vectors(spark, sf)).hits(q.VectorQ("embedding", _TARGET, 10)))


@query
def vector_nearest_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_docs_only(_vectors(spark, sf)).hits(q.VectorQ("embedding", _TARGET, 10, q.RangeQ("label", 3, 5))))


@query
def vector_int8(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, "codes")
    if key not in _HELD:
        _HELD[key] = vector_index.coded(_vectors(spark, sf), "embedding")
    return _rounded(_HELD[key].search(list(_TARGET), 10))


@query
def vector_sign_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 50."""
    own = _vectors(spark, sf)
    return vector_index.signs(own, "embedding", _asked(own), 10).withColumn("score", F.round("score", 6))


def _asked(own: DataFrame) -> DataFrame:
    return own.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))


@query
def vector_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 50."""
    own = _vectors(spark, sf)
    asked = _asked(own)
    return vector_index.cluster(own, "embedding", 16).search(asked, 10, 12)


# -- results


def _hits(spark: SparkSession, sf: str):
    s = _search(spark, sf)
    return s.hits(T("weeks")), s.index.docs


@query
def count_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)[0].agg(F.count(F.lit(1)).alias("n"))


@query
def sort_by_column(spark: SparkSession, sf: str) -> DataFrame:
    hits, docs = _hits(spark, sf)
    return collect.sort_by(hits, docs, [("n_chars", True)], 25).select("doc_id", "n_chars")


@query
def sort_by_string(spark: SparkSession, sf: str) -> DataFrame:
    hits, docs = _hits(spark, sf)
    return collect.sort_by(hits, docs, [("source", False), ("doc_id", True)], 25).select("doc_id", "source")


@query
def paging(spark: SparkSession, sf: str) -> DataFrame:
    return collect.top(_rounded(_search(spark, sf).hits(q.AllQ())), 10, 20)


@query
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits, docs = _hits(spark, sf)
    return collect.facets(hits, docs, "source")


@query
def stats_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    hits, docs = _hits(spark, sf)
    return collect.stats(hits, docs, "n_chars").select("count", "min", "max", "sum", F.round("avg", 6).alias("avg"))


@query
def histogram_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    hits, docs = _hits(spark, sf)
    return collect.histogram(hits, docs, "n_chars", 250.0)


@query
def collapse_top(spark: SparkSession, sf: str) -> DataFrame:
    hits, docs = _hits(spark, sf)
    return collect.collapse(_rounded(hits), docs, "source", 100)


@query
def collapse_lowest(spark: SparkSession, sf: str) -> DataFrame:
    hits, docs = _hits(spark, sf)
    return collect.collapse(_rounded(hits), docs, "lang", 100, lowest=True)


@query
def highlights(spark: SparkSession, sf: str) -> DataFrame:
    s = _search(spark, sf)
    found = T("river") & T("weeks")
    return collect.fetch(s.hits(found), s.index.docs, ["text"]).select("doc_id", highlight.highlight(F.col("text"), found, "text").alias("snippet"))


@query
def highlights_by_sentence(spark: SparkSession, sf: str) -> DataFrame:
    s = _search(spark, sf)
    found = q.PhraseQ("text", ("two", "weeks"))
    made = highlight.highlight(F.col("text"), found, "text", size=120, sentences=True, as_phrases=True)
    return collect.fetch(s.hits(found), s.index.docs, ["text"]).select("doc_id", made.alias("snippet"))


@query
def completions(spark: SparkSession, sf: str) -> DataFrame:
    return suggest.complete(documents_index(spark, sf).term_stats, "text", "har", 20)


@query
def spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections of every misspelling among the terms of the documents."""
    words = table(spark, sf, "misspelling").select(F.lower("misspelled").alias("word"))
    return suggest.correct(documents_index(spark, sf).term_stats, "text", words, 2, 3).withColumn("score", F.round("score", 6))


@query
def explanation(spark: SparkSession, sf: str) -> DataFrame:
    s = _search(spark, sf)
    first = s.search(T("river"), 1).first()
    out = s.explain(T("river"), first["doc_id"] if first else -1)
    return out.select("doc_id", "term", "tf", "dl", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"))


# -- index and its maintenance


@query
def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return documents_index(spark, sf).term_stats.where("field = 'text'").select("term", "df", "cf")


@query
def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return documents_index(spark, sf).corpus_stats.select("field", "n_docs", "sum_dl", F.round("avgdl", 6).alias("avgdl"))


@query
def index_check(spark: SparkSession, sf: str) -> DataFrame:
    """Empty: a sound index contradicts itself nowhere."""
    return maintain.check(documents_index(spark, sf))


@query
def deleted_by_term(spark: SparkSession, sf: str) -> DataFrame:
    left = maintain.delete_by_term(documents_index(spark, sf), "text", "river")
    return _rounded(Searcher(left).hits(T("weeks")))


@query
def updated_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Wire texts replaced by their titles."""
    own = documents_index(spark, sf)
    wire = own.docs.where("source = 'ferry_wire'")
    changed = maintain.update(own, wire, wire.withColumn("text", F.col("title")))
    return _rounded(Searcher(changed).hits(T("weeks") | T("harbour")))


@query
def soft_deleted(spark: SparkSession, sf: str) -> DataFrame:
    own = documents_index(spark, sf)
    at = F.lit(dt.datetime(2025, 1, 1)).cast("timestamp")
    left = maintain.soft_delete(own, own.docs.where("source = 'ferry_wire'"), at)
    return left.docs.groupBy(F.col("deleted_at").isNotNull().alias("deleted")).agg(F.count(F.lit(1)).alias("n"))


@query
def merged_indexes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    a, b = (ix.build(docs.where(w), [TEXT]) for w in ("doc_id <= 400", "doc_id > 400"))
    return _rounded(Searcher(maintain.merge(a, b)).hits(T("river")))


@query
def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    schema = Schema((FieldSpec("text", required=True), FieldSpec("source", kind="string", required=True)))
    return schema.violations(table(spark, sf, "documents"))


@query
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return js.fields(table(spark, sf, "events"), "event_id", "props").select("doc_id", "field", "value", "kind")


@query
def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    return js.documents(table(spark, sf, "events"), "event_id", "props", "k long")


@query
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    terms = an.standard().budget(50).terms(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(F.coalesce(terms, F.array().cast("array<string>"))).cast("long").alias("n"))


@query
def encoded_times(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("fetched_at")
    return table(spark, sf, "documents").select(
        "doc_id", ENCODERS["unix_millis"](at).alias("millis"), ENCODERS["unix_seconds"](at).alias("seconds"),
        ENCODERS["day_number"](at.cast("date")).cast("long").alias("day"), ENCODERS["ticks"](at).alias("ticks"),
    )


# -- analysis


def _tokens(name: str, make: Callable[[], Callable], column: str = "title", tab: str = "documents") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = make()(F.col(column))
        rows = spread(table(spark, sf, tab)).where(F.col(column).isNotNull()).select("doc_id", found.alias("t"))
        return rows.select("doc_id", F.posexplode("t").alias("pos", "term"))

    run.__name__ = name
    query(run)


def _filtered(name: str, make: Callable[[], Callable], column: str = "title", tab: str = "documents") -> None:
    _tokens(name, lambda: lambda c: make()(tokenisers.whitespace(c)), column, tab)


def _arabic(number):
    """A number in Arabic digits."""
    return F.translate(number.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")


_tokens("tokens_standard", lambda: tokenisers.standard, "text")
_tokens("tokens_whitespace", lambda: tokenisers.whitespace)
_tokens("tokens_letter", lambda: tokenisers.letter)
_tokens("tokens_keyword", lambda: tokenisers.keyword)
_tokens("tokens_pattern", lambda: tokenisers.pattern("[aeiou]+"))
_tokens("tokens_ngram", lambda: tokenisers.ngram(2, 3))
_tokens("tokens_ngram_by_word", lambda: tokenisers.ngram(2, 3, True))
_tokens("tokens_edge_ngram", lambda: tokenisers.edge_ngram(1, 4))
_tokens("tokens_icu", lambda: tokenisers.icu, "text")
_tokens("tokens_uax29", lambda: tokenisers.uax29, "body", "newsgroup_message")
_tokens("tokens_cjk_bigram", lambda: lambda c: tokenisers.cjk_bigram(F.concat(c, F.lit(" 漢字仮名 x"))))
_tokens("tokens_mediawiki", lambda: tokenisers.mediawiki, "text")
_tokens("chars_html_strip", lambda: lambda c: tokenisers.keyword(charfilters.html_strip(F.concat(F.lit("<p class='x'>"), c, F.lit("</p>&amp;b")))))
_tokens("chars_mapping", lambda: lambda c: tokenisers.keyword(charfilters.mapping({"th": "T", "a": "4"})(c)))
_tokens("chars_pattern_replace", lambda: lambda c: tokenisers.keyword(charfilters.pattern_replace("[aeiou]", "*")(c)))
_filtered("filter_lowercase", lambda: filters.lowercase)
_filtered("filter_stop", lambda: filters.stop(["river", "the", "a"]))
_filtered("filter_keep", lambda: filters.keep(["river", "harbour", "storm"]))
_filtered("filter_length", lambda: filters.length(4, 6))
_filtered("filter_truncate", lambda: filters.truncate(4))
_filtered("filter_limit", lambda: filters.limit(1))
_filtered("filter_reverse", lambda: filters.reverse)
_filtered("filter_accent_fold", lambda: filters.accent_fold, "text")
_filtered("filter_elision", lambda: filters.elision(), "text")
_tokens("filter_classic", lambda: lambda c: filters.classic(tokenisers.whitespace(F.concat(F.trim(c), F.lit("'s U.S.A. "), c))))
_filtered("filter_pattern_replace", lambda: filters.pattern_replace("[aeiou]", ""))
_tokens("filter_decimal_digits", lambda: lambda c: filters.decimal_digits(tokenisers.whitespace(F.concat(c, F.lit(" "), _arabic(F.col("doc_id"))))))
_filtered("filter_shingles", lambda: filters.shingles(2, 3), "title", "book_paragraph")
_filtered("filter_common_grams", lambda: filters.common_grams(["the", "of", "last"]), "title", "book_paragraph")
_tokens("filter_hyphenated", lambda: an.streamed(streams.whitespace, streams.word_delimiter(by_case=False, possessive=False), streams.hyphenated).terms, "id", "book_paragraph")
_filtered("filter_porter", lambda: filters.stem(stemmers.porter), "text")
_filtered("filter_light_english", lambda: filters.stem(stemmers.light_english), "text")
_tokens("analyse_german", lambda: an.language("de").terms, "text")
_tokens("analyse_french", lambda: an.language("fr").terms, "text")


@query
def filter_word_delimiter(spark: SparkSession, sf: str) -> DataFrame:
    made = filters.word_delimiter(original=True)(tokenisers.whitespace(F.col("id")))
    return table(spark, sf, "book_paragraph").where("id is not null").select("doc_id", F.explode(made).alias("t")).select("doc_id", "t.pos", "t.term").distinct()


@query
def filter_metaphone(spark: SparkSession, sf: str) -> DataFrame:
    made = filters.metaphone(inject=False)(F.array("name"))
    return table(spark, sf, "name_lexicon").select("name", F.explode(made).alias("t")).select("name", F.col("t.term").alias("code"))


@query
def filter_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    made = filters.synonyms({"river": ["stream"], "old letter": ["archive"]})(filters.lowercase(tokenisers.whitespace(F.col("title"))))
    return table(spark, sf, "documents").where("title is not null").select("doc_id", F.explode(made).alias("t")).select("doc_id", "t.pos", "t.term")


@query
def search_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of each text in its own language."""
    terms = an.by_language(F.col("text"), F.col("lang"), ["de", "fr", "es"])
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(terms).alias("term")).groupBy("term").agg(
        F.count_distinct("doc_id").alias("df")
    )


@query
def streamed_index(spark: SparkSession, sf: str) -> DataFrame:
    """A query on an index that followed the paragraphs as a stream."""
    import uuid

    from ..runtime import shared_dir
    from ..streaming import nrt

    own = table(spark, sf, "book_paragraph")
    stream = spark.readStream.schema(own.schema).format("parquet").load(f"{sf}/book_paragraph.parquet" if _is_folder(sf) else f"{sf}/book_paragraph.parque[t]")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    fields = [FieldSpec("body"), FieldSpec("title")]
    running = nrt.follow(stream, root, fields)
    running.awaitTermination()
    return _rounded(Searcher(nrt.refresh(spark, root, fields)).hits(q.TermQ("body", "river")))


def _is_folder(sf: str) -> bool:
    import os

    return os.path.isdir(f"{sf}/book_paragraph.parquet")


@query
def streamed_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of a streamed index of which a part came again in a later batch, with other texts."""
    from ..streaming import nrt

    own = table(spark, sf, "book_paragraph").where("body is not null").select("doc_id", "body")
    root = _folder(spark, "stream")
    fields = [FieldSpec("body")]
    nrt.append_batch(own, 0, root, fields)
    nrt.append_batch(own.where("doc_id % 3 = 0").withColumn("body", F.lit("river again")), 1, root, fields)
    index = nrt.refresh(spark, root, fields)
    return index.term_stats.where("term in ('river', 'again', 'the', 'water')").crossJoin(index.corpus_stats.select("n_docs", "sum_dl")).select("term", "df", "cf", "n_docs", "sum_dl")


@query
def merged_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of a stream merged into one, with a document that came twice."""
    from ..index.segments import everything
    from ..streaming import nrt

    own = table(spark, sf, "book_paragraph").where("body is not null").select("doc_id", "body")
    root = _folder(spark, "stream")
    fields = [FieldSpec("body")]
    nrt.append_batch(own.where("doc_id % 2 = 0"), 0, root, fields)
    nrt.append_batch(own.where("doc_id % 2 = 1"), 1, root, fields)
    nrt.append_batch(own.where("doc_id % 3 = 0").withColumn("body", F.lit("river again")), 2, root, fields)
    nrt.merge_batches(spark, root, everything)
    return _rounded(Searcher(nrt.refresh(spark, root, fields)).hits(q.TermQ("body", "river")))


@query
def migrated_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index of an older format, without offsets, written anew."""
    store = maintain.Store(spark, _folder(spark, "store"), [TEXT])
    name = store.commit(_small(spark, sf, "doc_id <= 300"))
    old = f"{store.path}/{name}/postings"
    spark.read.parquet(old).drop("starts", "ends").write.partitionBy("field").parquet(f"{store.path}/v0/postings")
    for part in ("docs", "term_stats", "corpus_stats"):
        spark.read.parquet(f"{store.path}/{name}/{part}").write.parquet(f"{store.path}/v0/{part}")
    store.publish("v0")
    states = sorted(store.formats().values())
    store.migrate()
    now = sorted(store.formats().values())
    hits = Searcher(store.open()).hits(T("weeks")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(",".join(states), ",".join(now))], "before string, after string").crossJoin(hits)


@query
def collection_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Predicates on fields as index queries."""
    own = Collection(_search(spark, sf))
    f = Fields(own.searcher.index.fields)
    asked = (f.text.has("weeks") | f.text.startswith("harb")) & (f.n_chars > 300) & (f.source != "ferry_wire") & f.title.exists()
    return own.where(asked).select("doc_id").frame()


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- token streams in an index


def _titles(spark: SparkSession, sf: str, name: str, analyser: an.Analyser, column: str = "title", offsets: bool = False, tab: str = "documents") -> Searcher:
    docs = table(spark, sf, tab)
    if tab != "documents":
        docs = docs.select("doc_id", column).distinct()
    return Searcher(_once(spark, sf, name, lambda: ix.build(docs, [FieldSpec(column, analyser=analyser, offsets=offsets)])))


_LOWER = (streams.whitespace, streams.lowercase)


def _streamed(name: str, filters_: tuple, asked: q.Query, column: str = "title", tab: str = "documents") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(_titles(spark, sf, name, an.streamed(*_LOWER, *filters_), column, tab=tab).hits(q.ConstantQ(asked)))

    run.__name__ = name
    query(run)


_streamed("phrase_of_synonyms", (streams.synonyms({"frozen": ["icy"], "early engine": ["prototype"]}),), q.or_(q.PhraseQ("title", ("icy", "morning")), q.TermQ("title", "prototype"), q.PhraseQ("title", ("cold", "meadow"))))
_streamed("term_of_shingles", (streams.shingles(2, 2),), q.or_(q.TermQ("title", "frozen morning"), q.PhraseQ("title", ("weary", "tide"))))
_streamed("phrase_of_common_grams", (streams.common_grams(["of", "the", "in"]),), q.TermQ("text", "of_the"), "text")
_streamed("term_of_delimited", (streams.word_delimiter(original=True),), q.or_(q.TermQ("id", "7"), q.TermQ("id", "4000-3")), "id", "book_paragraph")
_streamed("phrase_of_hyphenated", (streams.word_delimiter(), streams.hyphenated), q.PhraseQ("title", ("frozen", "morning")))
_streamed("term_of_codes", (streams.metaphone(),), q.TermQ("title", "FRSN"))


@query
def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each word of a text begins and ends."""
    s = _titles(spark, sf, "offsets", an.whitespace(), "text", offsets=True)
    rows = highlight.term_vectors(s.index, "text").select("doc_id", "term", F.explode(F.arrays_zip("positions", "starts", "ends")).alias("p"))
    return rows.select("doc_id", F.col("p.positions").alias("pos"), "term", F.col("p.starts").alias("first"), F.col("p.ends").alias("behind"))


@query
def term_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the documents that a search finds."""
    s = _search(spark, sf)
    return highlight.term_vectors(s.index, "text", s.hits(T("kettle"))).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query
def highlights_of_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Words marked in whole titles."""
    s = _search(spark, sf)
    found = q.TermQ("title", "morning") | q.PrefixQ("title", "engi")
    return collect.fetch(s.hits(found), s.index.docs, ["title"]).select("doc_id", highlight.highlight(F.col("title"), q.TermQ("title", "morning") | q.TermQ("title", "engine"), "title").alias("snippet"))


@query
def highlights_of_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Marked from the offsets of an index of stems; a prefix marks what it matched."""
    s = _titles(spark, sf, "stems", an.stemmed(), "title", offsets=True)
    found = q.TermQ("title", "morn") | q.PrefixQ("title", "engin")
    return highlight.highlight_postings(s.hits(found), s.index, found, "title")


@query
def highlights_of_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a phrase marked only where they stand in a row."""
    s = _titles(spark, sf, "marks", an.standard(), "title", offsets=True)
    found = q.PhraseQ("title", ("frozen", "morning"))
    return highlight.highlight_postings(s.hits(q.TermQ("title", "morning")), s.index, found, "title", as_phrases=True)


@query
def terms_of_query(spark: SparkSession, sf: str) -> DataFrame:
    asked = Parser("text").parse('+weeks river^2 "two men"~1 harb* -kettle title:old')
    found = [(f, t) for f, ts in highlight.query_terms(asked).items() for t in sorted(ts)]
    return spark.createDataFrame(found, "field string, term string")


@query
def parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Where queries that cannot be read go wrong."""
    rows = []
    for text in ("(river", 'a "open', "river^", "a )", "fine"):
        try:
            Parser("text").parse(text)
        except QueryError as e:
            rows.append((text, e.offset))
    return spark.createDataFrame(rows, "query string, place int")


@query
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_search(spark, sf).search_text("+weeks kettle", "text", 10))


@query
def search_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """A search with all the time it needs is whole; one without any is a part."""
    s = _search(spark, sf)
    rows, part = s.search_within(T("river") | T("weeks"), 10, 600.0, 2)
    return _rounded(rows).withColumns({"part": F.lit(part), "none_left": F.lit(s.search_within(T("river"), 10, 0.0)[1])})


@query
def similarity_own_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model made by the user: twice the frequency over the root of the length."""
    return _rounded(_search(spark, sf, lambda t: 2 * t.tf / F.sqrt(t.dl)).hits(T("river")))


@query
def explanation_vector(spark: SparkSession, sf: str) -> DataFrame:
    s = _docs_only(_vectors(spark, sf))
    return s.explain(q.VectorQ("embedding", _TARGET), 7).select("doc_id", *[F.round(c, 6).alias(c) for c in ("dot", "norm", "query_norm", "score")])


@query
def vector_probed(spark: SparkSession, sf: str) -> DataFrame:
    """The exact result, as all clusters are probed."""
    own = _vectors(spark, sf)
    s = _docs_only(own)
    s.vectors = {"embedding": vector_index.cluster(own, "embedding", 8)}
    return _rounded(s.hits(q.VectorQ("embedding", _TARGET, 10, q.RangeQ("label", 3, 5), probes=8)))


@query
def vector_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether approximate searches find nine tenths of the true neighbours, over all ids divisible by 50."""
    own = _vectors(spark, sf)
    asked = _asked(own)
    truth = vector_index.signs(own, "embedding", asked, 10).select("query_id", "doc_id")
    found = vector_index.cluster(own, "embedding", 16).search(asked, 10, 12).select("query_id", "doc_id")
    share = truth.join(found.withColumn("_f", F.lit(1)), ["query_id", "doc_id"], "left").agg((F.count("_f") / F.count(F.lit(1)) >= 0.9).alias("enough"))
    return share.select(F.lit("clusters").alias("method"), "enough")


# -- changes and versions


@query
def added_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    index = ix.build(docs.where("doc_id % 3 = 0"), [TEXT])
    for part in (1, 2):
        index = maintain.add(index, docs.where(F.col("doc_id") % 3 == part))
    return _rounded(Searcher(index).hits(T("river")))


@query
def added_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose lines were added with them, found by a line."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("status"), F.lit(0.0).alias("l_quantity"))
    line = table(spark, sf, "lineitem").select(
        F.xxhash64("*").alias("doc_id"), F.col("l_orderkey").alias("parent_id"), F.col("l_returnflag").alias("status"), "l_quantity"
    )
    none = ix.build(orders.where("false").withColumn("parent_id", F.lit(None).cast("long")), [FieldSpec("status", kind="string")])
    index = maintain.add_blocks(none, orders, line)
    return _rounded(Searcher(index).hits(q.ParentQ(q.TermQ("status", "R") & q.RangeQ("l_quantity", 49.0, 1e9))))


@query
def merged_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in both indexes count once."""
    docs = table(spark, sf, "documents")
    a, b = (ix.build(docs.where(w), [TEXT]) for w in ("doc_id <= 600", "doc_id > 400"))
    return _rounded(Searcher(maintain.merge(a, b)).hits(T("river")))


@query
def compacted_index(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(Searcher(maintain.compact(documents_index(spark, sf), 3)).hits(T("harbour") | T("weeks")))


@query
def sorted_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first documents of a sorted collection."""
    own = maintain.sorted_by(documents_index(spark, sf), [F.col("n_chars")])
    return collect.first_by(own.docs, "n_chars", 15).select("doc_id", "n_chars")


@query
def index_check_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with an index that lost the documents of a source, and has others twice."""
    import dataclasses

    own = documents_index(spark, sf)
    docs = own.docs.where("coalesce(source, '') <> 'ferry_wire'")
    return maintain.check(dataclasses.replace(own, docs=docs.unionByName(docs.where("doc_id % 7 = 0"))))


def _small(spark: SparkSession, sf: str, where: str) -> ix.Index:
    return ix.build(table(spark, sf, "documents").where(where), [TEXT])


@query
def committed_index(spark: SparkSession, sf: str) -> DataFrame:
    """A version prepared and rolled back leaves no trace, one prepared and published is found."""
    store = maintain.Store(spark, _folder(spark, "store"), [TEXT])
    store.commit(_small(spark, sf, "doc_id <= 300"))
    store.rollback(store.prepare(_small(spark, sf, "doc_id > 900")))
    store.publish(store.prepare(_small(spark, sf, "doc_id <= 500")))
    return _rounded(Searcher(store.open()).hits(T("weeks")))


@query
def snapshot_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A pinned version outlives a policy that keeps one version."""
    store = maintain.Store(spark, _folder(spark, "store"), [TEXT])
    first = store.commit(_small(spark, sf, "doc_id <= 300"))
    store.pin(first)
    second = store.commit(_small(spark, sf, "doc_id <= 400"))
    third = store.commit(_small(spark, sf, "doc_id <= 500"), keep=1)
    kept = [(n, n in store.versions()) for n in (first, second, third)]
    flags = [(i + 1, ok) for i, (_, ok) in enumerate(kept)]
    hits = Searcher(store.open(first)).hits(T("weeks")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(flags, "version int, kept boolean").crossJoin(hits)


@query
def restored_backup(spark: SparkSession, sf: str) -> DataFrame:
    store = maintain.Store(spark, _folder(spark, "store"), [TEXT])
    store.commit(_small(spark, sf, "doc_id <= 500"))
    copy = _folder(spark, "backup")
    store.backup(copy)
    other = maintain.Store(spark, _folder(spark, "store"), [TEXT])
    other.restore(copy)
    return _rounded(Searcher(other.open()).hits(T("river") | T("weeks")))


@query
def index_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of a stored index, and whether they take room."""
    store = maintain.Store(spark, _folder(spark, "store"), [TEXT])
    store.commit(_small(spark, sf, "doc_id <= 200"))
    return spark.createDataFrame([(t, n > 0) for t, n in store.sizes().items()], "name string, some boolean")


@query
def schema_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that a strict schema does not accept."""
    schema = Schema((FieldSpec("text", required=True), FieldSpec("n_chars", kind="text"), FieldSpec("gone", required=True)), strict=True)
    return spark.createDataFrame([(x,) for x in schema.problems(table(spark, sf, "documents"))], "problem string")


# -- results of one search, and front ends


@query
def search_with_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Best hits, facets and statistics from one search."""
    hits, docs = _hits(spark, sf)
    return collect.together(_rounded(hits), docs, 5, "source", "n_chars").fillna(-1, ["doc_id"])


@query
def cached_query(spark: SparkSession, sf: str) -> DataFrame:
    """The same hits from the cache, and how often it was asked."""
    cache = QueryCache(_search(spark, sf))
    cache.search(T("river"))
    hits = _rounded(cache.search(T("river")))
    return hits.withColumn("found", F.lit(cache.hits)).withColumn("missed", F.lit(cache.misses))


@query
def collection_filtered(spark: SparkSession, sf: str) -> DataFrame:
    own = Collection(_search(spark, sf))
    return own.where(F.col("n_chars") > 400).where(T("weeks")).order_by_descending("n_chars").skip(2).take(10).select("doc_id", "n_chars").frame()


@query
def collection_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last document of an order, found by one row each."""
    own = Collection(_search(spark, sf)).where(T("weeks")).order_by("n_chars").select("doc_id")
    return spark.createDataFrame([("first", own.first()["doc_id"]), ("last", own.last()["doc_id"]), ("third", own.element_at(2)["doc_id"])], "which string, doc_id long")


@query
def span_of_spans(spark: SparkSession, sf: str) -> DataFrame:
    """A span of alternatives and of a term."""
    either = q.SpanOrQ((q.SpanTermQ("text", "two"), q.SpanTermQ("text", "three")))
    return _rounded(_search(spark, sf).hits(q.SpanNearQ((either, q.SpanTermQ("text", "weeks")), 0, True)))


def queries() -> dict[str, Query]:
    from . import literals

    return _QUERIES | literals.queries()


def oracle_sql() -> dict[str, str]:
    from . import literals
    from .catalogue_sql import SQL

    return SQL | literals.oracle_sql()
