"""The catalogue's queries in SQL (DuckDB), over the same tables."""

from __future__ import annotations

from ..analysis.stopwords import STOP_WORDS
from ..index.schema import _EPOCH_TICKS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS["en"])
_FIND = r"regexp_extract_all({0}, '[\p{{L}}\p{{Nd}}]+')"

#: An index of documents.text and documents.title: toks, post, dl, stats, corpus.
_INDEX = f"""
  fields as (select 'text' as field, doc_id, text as v from documents union all select 'title', doc_id, title from documents),
  toks as (select field, doc_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos from (
             select field, doc_id, list_filter(list_transform({_FIND.format("v")}, lambda x: lower(x)), lambda x: x not in ({_STOPS})) as t
             from fields where v is not null)),
  post as (select field, doc_id, term, count(*) as tf from toks group by all),
  dl as (select field, doc_id, count(*) as dl from toks group by all),
  stats as (select field, term, count(*) as df, sum(tf) as cf from post group by all),
  corpus as (select field, (select count(*) from documents) as n, sum(dl) as sum_dl, sum(dl) / (select count(*) from documents) as avgdl
             from dl group by field)"""

_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_TFN = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
_BM25 = f"{_IDF} * {_TFN}"
_CLASSIC = "(1 + ln(n / (df + 1)))"


def _with(body: str, score: str = _BM25) -> str:
    """A query on ``scored (field, term, doc_id, tf, dl, df, cf, n, avgdl, sum_dl, s)``."""
    return f"""with {_INDEX},
      scored as (select *, {score} as s from post join dl using (field, doc_id) join stats using (field, term) join corpus using (field)),
      tx as (select * from scored where field = 'text')
      {body}"""


def _sum(where: str, times: str = "1.0", field: str = "text") -> str:
    return _with(f"select doc_id, round(sum(s * ({times})), 6) as score from scored where field = '{field}' and ({where}) group by doc_id")


def _flat(body: str, score: float = 1.0) -> str:
    return _with(f"select doc_id, cast({score} as double) as score from ({body})")


def _pos(*joins: str) -> str:
    return f"(select distinct a.doc_id from {' '.join(joins)})"


def _at(alias: str, term: str) -> str:
    return f"(select doc_id, pos from toks where field = 'text' and term = '{term}') {alias}"


def _phrase(terms: list[str], matched: str, boost: float = 1.0) -> str:
    """Scores of phrases: each term with the frequency of the rarest."""
    listed = ", ".join(f"'{t}'" for t in dict.fromkeys(terms))
    return _with(f"""
      , hit as {matched}, own as (select * from tx where term in ({listed}) and doc_id in (select doc_id from hit)),
      rare as (select doc_id, arg_min(tf, (df, tf)) as rtf from own group by doc_id)
      select doc_id, round({boost} * sum({_IDF} * (rtf * 2.2 / (rtf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) as score
      from own join rare using (doc_id) group by doc_id""")


_TWO_WEEKS = _pos(f"{_at('a', 'two')} join {_at('b', 'weeks')} on a.doc_id = b.doc_id and b.pos = a.pos + 1")
_HITS = "hits as (select doc_id, s as score from tx where term = 'weeks')"
_FUZZY = "levenshtein(term, '{0}') <= 2 and abs(length(term) - {1}) <= 2"


def _function(made: str) -> str:
    return _with(f"select doc_id, round(case when n_chars is null then s else {made} end, 6) as score from tx join documents using (doc_id) where term = 'river'")


def _combined(terms: str, least: int, weights: str) -> str:
    return _with(f"""
      , part as (select doc_id, term, sum(({weights}) * tf / (0.25 + 0.75 * dl / avgdl)) as pf, max(n) as n from scored
                 where term in ({terms}) group by all),
      u as (select term, count(*) as df from part group by term)
      select doc_id, round(sum({_IDF} * pf * 2.2 / (pf + 1.2)), 6) as score from part join u using (term) group by doc_id having count(*) >= {least}""")


_T = [((i * 37) % 19 - 9) / 9.0 for i in range(64)]
_TARGET = "[" + ", ".join(f"cast({x!r} as double)" for x in _T) + "]"
_COS = f"coalesce(list_dot_product(cast(embedding as double[]), {_TARGET}) / nullif(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product({_TARGET}, {_TARGET})), 0), 0)"
_PLACES = """(select c_custkey as doc_id, (c_custkey * 37) % 1700 / 10.0 - 85.0 as lat, (c_custkey * 91) % 3590 / 10.0 - 179.5 as lon from customer)"""
_HAVERSINE = """12742000.0 * asin(sqrt(least(1.0, pow(sin(radians(48.2 - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(48.2)) * pow(sin(radians(16.4 - lon) / 2), 2))))"""

_SIM = {
    "bm25": _BM25,
    "bm25_plus": f"{_IDF} * ({_TFN} + 1.0)",
    "bm25_l": f"{_IDF} * ({_TFN} + 0.5 * tf / (1 + tf))",
    "tf_idf": f"sqrt(tf) * {_CLASSIC} / sqrt(dl)",
    "tf_idf_augmented": f"(0.5 + 0.5 * tf / (tf + 0.5)) * {_CLASSIC} / sqrt(dl)",
    "tf_idf_double_norm": f"(0.5 + 0.5 * tf / (tf + 0.5)) * {_CLASSIC} / (0.8 + 0.2 * dl / avgdl)",
    "tf_idf_pivoted": f"sqrt(tf) * {_CLASSIC} / (0.8 + 0.2 * dl / avgdl)",
    "lm_dirichlet": "ln((tf + 2000.0 * cf / sum_dl) / (dl + 2000.0))",
    "lm_jelinek_mercer": "ln(0.9 * tf / dl + 0.1 * cf / sum_dl)",
    "lm_absolute_discount": "ln((greatest(tf - 0.7, 0) + 0.7 * dl * cf / sum_dl) / dl)",
}


def _tokens(list_: str, where: str = "title is not null", tab: str = "documents", pre: str = "") -> str:
    return f"""{pre} select doc_id, cast(generate_subscripts(t, 1) - 1 as int) as pos, unnest(t) as term
      from (select doc_id, {list_} as t from {tab} where {where}) where len(t) > 0"""


def _words(each: str, column: str = "title") -> str:
    return _tokens(f"list_transform(regexp_extract_all({column}, '\\S+'), lambda x: {each})", f"{column} is not null")


def _kept(test: str) -> str:
    return _tokens(f"list_filter(regexp_extract_all(title, '\\S+'), lambda x: {test})")


_W = r"regexp_extract_all(title, '\S+')"
_GRAMS = "flatten(list_transform(range(1, greatest(length({0}), 1)), lambda s: list_transform(range(2, least(3, length({0}) - s + 1) + 1), lambda k: substring({0}, s, k))))"
_NEARBY = lambda a, b: f"{_at('a', a)} join {_at('b', b)} on a.doc_id = b.doc_id and"

SQL: dict[str, str] = {
    "term": _sum("term = 'river'"),
    "term_boosted": _sum("term = 'river'", "2.5"),
    "terms_in_set": _flat("select distinct doc_id from tx where term in ('river', 'harbour', 'kettle')"),
    "term_range": _sum("term >= 'rain' and term < 'rams'"),
    "prefix": _sum("starts_with(term, 'harb')"),
    "wildcard": _sum("regexp_full_match(term, 'st.r.*m')"),
    "wildcard_suffix": _sum("ends_with(term, 'spring')"),
    "regexp": _sum("regexp_matches(term, '^har.*(our|row)$')"),
    "fuzzy": _with(f"""
      , near as (select term, levenshtein(term, 'rivr') as d from stats where field = 'text' and {_FUZZY.format("rivr", 4)} order by d, df desc, term limit 64)
      select doc_id, round(sum(s * (1 - d / 3.0)), 6) as score from tx join near using (term) group by doc_id"""),
    "fuzzy_expansions": _with(f"""
      , near as (select term, levenshtein(term, 'stane') as d from stats where field = 'text' and {_FUZZY.format("stane", 5)} order by d, df desc, term limit 5)
      select doc_id, round(sum(s * (1 - d / 3.0)), 6) as score from tx join near using (term) group by doc_id"""),
    "match_all": "select doc_id, cast(0.5 as double) as score from documents",
    "match_none": "select doc_id, cast(1.0 as double) as score from documents where false",
    "exists_text": _flat("select distinct doc_id from tx"),
    "exists_column": "select doc_id, cast(1.0 as double) as score from documents where lang is not null",
    "phrase": _phrase(["two", "weeks"], _TWO_WEEKS),
    "phrase_of_three": _phrase(["two", "weeks", "later"], _pos(f"{_at('a', 'two')} join {_at('b', 'weeks')} on a.doc_id = b.doc_id and b.pos = a.pos + 1 join {_at('c', 'later')} on c.doc_id = a.doc_id and c.pos = a.pos + 2")),
    "phrase_slop": _phrase(["weeks", "two"], _pos(_NEARBY("weeks", "two") + " b.pos between a.pos - 1 and a.pos + 3")),
    "multi_phrase": _flat("""select distinct a.doc_id from (select * from toks where field = 'text' and term in ('two', 'three')) a
      join (select * from toks where field = 'text' and term in ('weeks', 'men')) b on a.doc_id = b.doc_id and b.pos = a.pos + 1"""),
    "multi_phrase_slop": _flat("""select distinct a.doc_id from (select * from toks where field = 'text' and term in ('nobody', 'someone')) a
      join (select * from toks where field = 'text' and term in ('field', 'harbour')) b on a.doc_id = b.doc_id and b.pos >= a.pos and abs(b.pos - a.pos - 1) <= 4"""),
    "span_term": _sum("term = 'kettle'"),
    "span_near_ordered": _phrase(["nobody", "than"], _pos(_NEARBY("nobody", "than") + " b.pos > a.pos and b.pos - a.pos <= 7")),
    "span_near_unordered": _phrase(["field", "old"], _pos(_NEARBY("field", "old") + " abs(b.pos - a.pos) <= 4")),
    "span_or": _with("select doc_id, round(arg_min(s, case when term = 'river' then 0 else 1 end), 6) as score from tx where term in ('river', 'harbour') group by doc_id"),
    "span_not": _with("select doc_id, round(s, 6) as score from tx where term = 'river' and doc_id not in (select doc_id from tx where term = 'kettle')"),
    "intervals_phrase": _flat(f"select doc_id from {_TWO_WEEKS}"),
    "intervals_or": _flat("select distinct doc_id from tx where term in ('river', 'kettle')"),
    "intervals_ordered": _flat(f"select doc_id from {_pos(_NEARBY('nobody', 'than') + ' b.pos >= a.pos + 1 and b.pos - a.pos - 1 <= 5')}"),
    "intervals_unordered": _flat(f"select doc_id from {_pos(_NEARBY('field', 'old') + ' abs(b.pos - a.pos) - 1 <= 4')}"),
    "intervals_containing": _flat(f"select doc_id from {_pos(_NEARBY('two', 'later') + f' b.pos > a.pos and b.pos - a.pos - 1 <= 3 join {_at("c", "weeks")} on c.doc_id = a.doc_id and c.pos between a.pos and b.pos')}"),
    "intervals_contained_by": _flat(f"select doc_id from {_pos(_NEARBY('two', 'later') + f' b.pos > a.pos and b.pos - a.pos - 1 <= 3 join {_at("c", "weeks")} on c.doc_id = a.doc_id and c.pos between a.pos and b.pos')}"),
    "intervals_not_containing": _flat(f"""select doc_id from {_pos(_NEARBY('two', 'men') + f''' b.pos > a.pos and b.pos - a.pos - 1 <= 4
      where not exists (select 1 from {_at("c", "weeks")} where c.doc_id = a.doc_id and c.pos between a.pos and b.pos)''')}"""),
    "bool_must": _with("select doc_id, round(sum(s), 6) as score from tx where term in ('river', 'weeks') group by doc_id having count(*) = 2"),
    "bool_should": _sum("term in ('river', 'harbour', 'kettle')", "case when term = 'kettle' then 2.0 else 1.0 end"),
    "bool_mixed": _with("""select doc_id, round(sum(s), 6) as score from tx where term in ('weeks', 'river') or starts_with(term, 'harb') group by doc_id
      having sum(case when term = 'weeks' then 1 else 0 end) = 1 and doc_id not in (select doc_id from tx where term = 'kettle')"""),
    "bool_must_not_only": _with("select doc_id, cast(0.0 as double) as score from documents where doc_id not in (select doc_id from tx where term = 'weeks')"),
    "bool_least_should": _with("select doc_id, round(sum(s), 6) as score from tx where term in ('river', 'weeks', 'nobody') group by doc_id having count(*) >= 2"),
    "bool_nested": _with(f"""select doc_id, round(sum(s), 6) as score from tx where term in ('river', 'harbour')
      and doc_id not in (select doc_id from {_TWO_WEEKS}) group by doc_id"""),
    "constant_score": _flat("select doc_id from tx where term = 'river'", 3.0),
    "dis_max": _with("select doc_id, round(max(s) + 0.3 * (sum(s) - max(s)), 6) as score from tx where term in ('river', 'harbour', 'weeks') group by doc_id"),
    "function_score_multiply": _function("s * n_chars"),
    "function_score_replace": _function("n_chars"),
    "function_score_sum": _function("s + n_chars"),
    "function_score_max": _function("greatest(s, n_chars)"),
    "combined_fields": _combined("'river', 'harbour', 'kettle'", 1, "case when field = 'title' then 3.0 else 1.0 end"),
    "combined_fields_least_two": _combined("'river', 'weeks', 'nobody'", 2, "1.0"),
    "more_like_this": _with("""
      , asked as (select field, term, tf * ln(n / (df + 1)) as w from tx where doc_id = 7 and df >= 2 and length(term) >= 3 and tf * ln(n / (df + 1)) > 0
                  order by w desc, field, term limit 10),
      scaled as (select field, term, w / (select max(w) from asked) as w from asked)
      select doc_id, round(sum(s * w), 6) as score from tx join scaled using (field, term) where doc_id <> 7 group by doc_id"""),
    "rank_fusion": _with("""
      , a as (select doc_id, row_number() over (order by s desc, doc_id) as r from tx where term = 'river'),
      bs as (select doc_id, sum(s) as s from tx where starts_with(term, 'harb') group by doc_id),
      b as (select doc_id, row_number() over (order by s desc, doc_id) as r from bs)
      select doc_id, round(sum(1.0 / (60 + r)), 6) as score from (select * from a where r <= 20 union all select * from b where r <= 20) group by doc_id"""),
    "parsed_query": _with(f"""
      , must as (select doc_id, sum(s) as s from tx where term in ('river', 'harbour') group by doc_id),
      own as (select * from tx where term in ('two', 'weeks') and doc_id in (select doc_id from {_TWO_WEEKS})),
      rare as (select doc_id, arg_min(tf, (df, tf)) as rtf from own group by doc_id),
      opt as (select doc_id, sum({_IDF} * (rtf * 2.2 / (rtf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) as s from own join rare using (doc_id) group by doc_id)
      select doc_id, round(must.s + coalesce(opt.s, 0), 6) as score from must left join opt using (doc_id)
      where doc_id not in (select doc_id from scored where field = 'title' and term = 'river')"""),
    "range_double": "select p_partkey as doc_id, cast(1.0 as double) as score from part where p_retailprice between 950.0 and 1100.0",
    "range_int64": "select o_orderkey as doc_id, cast(1.5 as double) as score from orders where o_custkey between 100 and 300",
    "points_int64": "select o_orderkey as doc_id, cast(1.0 as double) as score from orders where o_custkey in (7, 70, 700)",
    "points_double": "select l_orderkey as doc_id, cast(1.0 as double) as score from lineitem group by 1 having max(l_quantity) in (11.0, 13.0)",
    "range_many_valued": "select distinct l_orderkey as doc_id, cast(1.0 as double) as score from lineitem where l_quantity between 49.0 and 50.0",
    "geo_box": f"select doc_id, cast(1.0 as double) as score from {_PLACES} where lat between -20.0 and 35.5 and lon between -40.0 and 60.0",
    "geo_distance": f"select doc_id, cast(1.0 as double) as score from {_PLACES} where {_HAVERSINE} <= 1500000.0",
    "geo_encoding": f"""select doc_id, cast(floor(least((lat + 90.0) / 180.0 * 4294967296.0, 4294967295.0) - 2147483648.0) as int) as lat_code,
      cast(floor(least((lon + 180.0) / 360.0 * 4294967296.0, 4294967295.0) - 2147483648.0) as int) as lon_code from {_PLACES}""",
    "block_join": "select distinct l_orderkey as doc_id, cast(1.0 as double) as score from lineitem where l_quantity > 49.5",
    "vector_cosine": f"select vec_id as doc_id, round({_COS}, 6) as score from embeddings",
    "vector_nearest": f"select doc_id, round(score, 6) as score from (select vec_id as doc_id, {_COS} as score from embeddings order by score desc, doc_id limit 10)",
    "vector_nearest_filtered": f"select doc_id, round(score, 6) as score from (select vec_id as doc_id, {_COS} as score from embeddings where label between 3 and 5 order by score desc, doc_id limit 10)",
    "count_hits": _with("select count(*) as n from tx where term = 'weeks'"),
    "sort_by_column": _with(f", {_HITS} select doc_id, n_chars from hits join documents using (doc_id) order by coalesce(n_chars, 0) desc, doc_id limit 25"),
    "sort_by_string": _with(f", {_HITS} select doc_id, source from hits join documents using (doc_id) order by coalesce(source, ''), doc_id desc limit 25"),
    "paging": "select doc_id, cast(1.0 as double) as score from documents order by doc_id limit 10 offset 20",
    "facet_counts": _with(f", {_HITS} select source as value, count(*) as count from hits join documents using (doc_id) where source <> '' group by source"),
    "stats_aggregation": _with(f""", {_HITS} select count(n_chars) as count, cast(min(n_chars) as double) as min, cast(max(n_chars) as double) as max,
      cast(sum(n_chars) as double) as sum, round(avg(n_chars), 6) as avg from hits join documents using (doc_id)"""),
    "histogram_aggregation": _with(f""", {_HITS}, v as (select cast(floor(n_chars / 250.0) as bigint) as i from hits join documents using (doc_id) where n_chars is not null),
      every as (select unnest(range((select min(i) from v), (select max(i) from v) + 1)) as i)
      select cast(i * 250.0 as double) as bucket, count(v.i) as count from every left join v using (i) group by i"""),
    "collapse_top": _with(f""", {_HITS}, j as (select doc_id, round(score, 6) as score, coalesce(source, '__null__') as g from hits join documents using (doc_id))
      select g as "group", doc_id, score, size from (select *, row_number() over (partition by g order by score desc, doc_id) as r,
      count(*) over (partition by g) as size from j) where r = 1 order by score desc, doc_id limit 100"""),
    "collapse_lowest": _with(f""", {_HITS}, j as (select doc_id, round(score, 6) as score, coalesce(lang, '__null__') as g from hits join documents using (doc_id))
      select g as "group", doc_id, score, size from (select *, row_number() over (partition by g order by score, doc_id) as r,
      count(*) over (partition by g) as size from j) where r = 1 order by score desc, doc_id limit 100"""),
    "completions": _with("select term, df from stats where field = 'text' and starts_with(term, 'har') order by df desc, term limit 20"),
    "term_statistics": _with("select term, df, cast(cf as bigint) as cf from stats where field = 'text'"),
    "deleted_by_term": None,
    "soft_deleted": "select coalesce(source, '') = 'ferry_wire' as deleted, count(*) as n from documents group by 1",
    "merged_indexes": _sum("term = 'river'"),
    "schema_violations": """select doc_id, 'text is null' as problem from documents where text is null
      union all select doc_id, 'source is null' from documents where source is null""",
    "json_fields": """select event_id as doc_id, 'k' as field, json_extract_string(props, '$.k') as value, 'int64' as kind from events where json_extract_string(props, '$.k') is not null""",
    "json_columns": "select event_id as doc_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "token_budget": f"""select doc_id, cast(least(50, coalesce(len(list_filter({_FIND.format("text")}, lambda x: lower(x) not in ({_STOPS}))), 0)) as bigint) as n from documents""",
    "encoded_times": f"""select doc_id, cast(floor(epoch_us(fetched_at) / 1000.0) as bigint) as millis, cast(floor(epoch_us(fetched_at) / 1000000.0) as bigint) as seconds,
      cast(date_diff('day', date '0001-01-01', cast(fetched_at at time zone 'UTC' as date)) as bigint) as day, epoch_us(fetched_at) * 10 + {_EPOCH_TICKS} as ticks from documents""",
    "index_check": "select '' as problem, cast(0 as bigint) as rows where false",
    "search_by_language": None,
    "tokens_standard": _tokens(_FIND.format("text"), "text is not null"),
    "tokens_whitespace": _tokens(_W),
    "tokens_letter": _tokens(r"regexp_extract_all(title, '\p{L}+')"),
    "tokens_keyword": _tokens("[title]"),
    "tokens_pattern": _tokens("regexp_extract_all(title, '[aeiou]+')"),
    "tokens_ngram": _tokens(_GRAMS.format("title")),
    "tokens_ngram_by_word": _tokens(f"flatten(list_transform({_W}, lambda w: {_GRAMS.format('w')}))"),
    "tokens_edge_ngram": _tokens(f"flatten(list_transform({_W}, lambda w: list_transform(range(1, least(4, length(w)) + 1), lambda k: substring(w, 1, k))))"),
    "tokens_icu": _tokens(r"regexp_extract_all(text, '[\p{L}\p{Nd}\p{M}]+(?:[''’_.-][\p{L}\p{Nd}\p{M}]+)*')", "text is not null"),
    "tokens_cjk_bigram": _tokens(f"list_concat({_FIND.format('title')}, ['漢字', '字仮', '仮名', 'x'])"),
    "chars_html_strip": _tokens(r"[regexp_replace(regexp_replace('<p class=''x''>' || title || '</p>&amp;b', '<[^>]*>?', ' ', 'g'), '&[A-Za-z0-9_]*;', ' ', 'g')]"),
    "chars_mapping": _tokens("[replace(replace(title, 'th', 'T'), 'a', '4')]"),
    "chars_pattern_replace": _tokens("[regexp_replace(title, '[aeiou]', '*', 'g')]"),
    "filter_lowercase": _words("lower(x)"),
    "filter_stop": _kept("lower(x) not in ('river', 'the', 'a')"),
    "filter_keep": _kept("lower(x) in ('river', 'harbour', 'storm')"),
    "filter_length": _kept("length(x) between 4 and 6"),
    "filter_truncate": _words("substring(x, 1, 4)"),
    "filter_limit": _tokens(f"list_slice({_W}, 1, 1)"),
    "filter_reverse": _words("reverse(x)"),
    "filter_accent_fold": _words("strip_accents(x)", "text"),
    "filter_elision": _words("regexp_replace(x, '^(?i:jusqu|quoiqu|lorsqu|puisqu|qu|l|m|t|n|s|j|d|c)[' || chr(39) || '’]', '')", "text"),
    "filter_classic": _tokens(f"list_concat(list_concat({_W}, ['USA']), {_W})"),
    "filter_pattern_replace": _words("regexp_replace(x, '[aeiou]', '', 'g')"),
    "filter_decimal_digits": _tokens(f"list_append({_W}, cast(doc_id as varchar))"),
    "filter_shingles": _tokens(f"""list_concat({_W}, list_concat(
      list_transform(range(1, greatest(len({_W}), 1)), lambda i: array_to_string(list_slice({_W}, i, i + 1), ' ')),
      list_transform(range(1, greatest(len({_W}) - 1, 1)), lambda i: array_to_string(list_slice({_W}, i, i + 2), ' '))))""", tab="book_paragraph"),
    "filter_common_grams": _tokens(f"""list_concat({_W}, list_transform(list_filter(range(1, greatest(len({_W}), 1)),
      lambda i: {_W}[i] in ('the', 'of', 'last') and {_W}[i + 1] in ('the', 'of', 'last')), lambda i: {_W}[i] || '_' || {_W}[i + 1]))""", tab="book_paragraph"),
    "filter_hyphenated": _tokens("[id]", "id is not null", "book_paragraph"),
    **{f"similarity_{k}": _with("select doc_id, round(sum(s), 6) as score from tx where term in ('river', 'harbour') group by doc_id", v) for k, v in _SIM.items()},
}

SQL["corpus_statistics"] = f"""with {_INDEX}, d as (select count(*) as n from documents),
  src as (select count(*) as s from documents where source is not null)
  select field, cast(n as bigint) as n_docs, cast(sum_dl as bigint) as sum_dl, round(avgdl, 6) as avgdl from corpus
  union all select 'source', n, s, round(s / n, 6) from d, src"""
SQL["term_in_string_field"] = """with x as (select count(*) as df from documents where source = 'ferry_wire'), d as (select count(*) as n, count(source) / count(*) as avgdl from documents)
  select doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (2.2 / (1 + 1.2 * (0.25 + 0.75 / avgdl))), 6) as score from documents, x, d where source = 'ferry_wire'"""
SQL["explanation"] = _with(f"""select doc_id, term, cast(tf as int) as tf, cast(dl as int) as dl, df, n as n_docs, round(avgdl, 6) as avgdl, round({_IDF}, 6) as idf, round(s, 6) as score
  from tx where term = 'river' order by s desc, doc_id limit 1""")
SQL["batch_search"] = _with("""
  , asked as (select distinct doc_id as query_id, term from toks where field = 'title'),
  sums as (select query_id, doc_id, sum(s) as s from tx join asked using (term) group by all)
  select query_id, doc_id, round(s, 6) as score from (select *, row_number() over (partition by query_id order by s desc, doc_id) as r from sums) where r <= 3""")
#: DuckDB counts edits in bytes; letters with marks become single capitals first.
_ASCII = "translate({0}, 'áéíóúñüäößèêçàâîôûëïœùæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"
SQL["spelling"] = _with("""
  , words as (select distinct lower(misspelled) as word from misspelling where misspelled <> ''),
  terms as (select term, df from stats where field = 'text'),
  grams as (select word, list_distinct(list_transform(range(1, greatest(length(word) - 1, 1)), lambda i: substring(word, i, 3))) as g from words),
  tgrams as (select term, df, list_distinct(list_transform(range(1, greatest(length(term) - 1, 1)), lambda i: substring(term, i, 3))) as g from terms),
  pairs as (select word, term, df, levenshtein(""" + _ASCII.format("word") + ", " + _ASCII.format("term") + """) as distance from grams a join tgrams b on abs(length(word) - length(term)) <= 2 and word <> term
            and (length(word) < 3 or len(list_intersect(a.g, b.g)) >= greatest(1, len(a.g) - 6)))
  select word, term, cast(distance as int) as distance, df, round(df / (1 + distance), 6) as score from (
    select *, row_number() over (partition by word order by df / (1 + distance) desc, distance, term) as r from pairs where distance <= 2) where r <= 3""")
SQL["flagship_top10"] = _with(f"""
  , ok as (select distinct doc_id from tx where term = 'weeks' and doc_id not in (select doc_id from tx where term = 'kettle')),
  near as {_pos(_NEARBY('two', 'weeks') + ' b.pos between a.pos and a.pos + 2')},
  own as (select * from tx where term in ('two', 'weeks') and doc_id in (select doc_id from near)),
  rare as (select doc_id, arg_min(tf, (df, tf)) as rtf from own group by doc_id),
  parts as (
    select doc_id, s from tx where term = 'weeks' union all select doc_id, 2 * s from tx where term = 'river'
    union all select doc_id, sum(s) from tx where starts_with(term, 'harb') group by doc_id
    union all select doc_id, sum({_IDF} * (rtf * 2.2 / (rtf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) from own join rare using (doc_id) group by doc_id)
  select doc_id, round(s, 6) as score, source from (select doc_id, sum(s) as s from parts join ok using (doc_id) group by doc_id order by s desc, doc_id limit 10)
  join documents using (doc_id)""")
_GONE = "documents where doc_id not in (select doc_id from documents where list_contains(list_transform(" + _FIND.format("coalesce(text, '')") + ", lambda x: lower(x)), 'river'))"
SQL["deleted_by_term"] = _with("select doc_id, round(s, 6) as score from tx where term = 'weeks'").replace("from documents", f"from ({'select * from ' + _GONE})")
SQL["updated_documents"] = _with("select doc_id, round(sum(s), 6) as score from tx where term in ('weeks', 'harbour') group by doc_id").replace(
    "from documents", "from (select * replace (case when source = 'ferry_wire' then title else text end as text) from documents)"
)
SQL["streamed_index"] = _with("select doc_id, round(s, 6) as score from tx where term = 'river'").replace(
    "from documents", "from (select doc_id, any_value(body) as text, any_value(title) as title from book_paragraph where doc_id is not null group by doc_id)"
)
SQL["tokens_uax29"] = _tokens(
    r"""regexp_extract_all(body, '(?:https?|ftp)://[^\s<>"]+[^\s<>".,;:!?)\]]'
      || '|[\p{L}\p{Nd}._%+-]+@[\p{L}\p{Nd}-]+(?:\.[\p{L}\p{Nd}-]+)+'
      || '|[#@][\p{L}\p{Nd}_]+'
      || '|[\p{L}\p{Nd}\p{M}]+(?:[''’_.-][\p{L}\p{Nd}\p{M}]+)*')""",
    "body is not null", "newsgroup_message",
)
SQL["vector_int8"] = SQL["vector_nearest"]
#: Titles and texts as words in lower case: w (doc_id, w).
_LOW = "w as (select doc_id, regexp_extract_all(lower({0}), '\\S+') as w from documents where {0} is not null)"


def _ids(where: str, column: str = "title") -> str:
    return f"with {_LOW.format(column)} select distinct doc_id, cast(1.0 as double) as score from w where {where}"


def _row(*words: str) -> str:
    """Words in a row."""
    test = " and ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(words))
    return f"len(list_filter(range(1, len(w) + 1), lambda i: {test})) > 0"


SQL["phrase_of_synonyms"] = _ids(" or ".join([_row("frozen", "morning"), _row("early", "engine"), _row("cold", "meadow")]))
SQL["term_of_shingles"] = _ids(" or ".join([_row("frozen", "morning"), _row("weary", "tide")]))
SQL["phrase_of_common_grams"] = _ids(_row("of", "the"), "text")
SQL["phrase_of_hyphenated"] = _ids(_row("frozen", "morning"))
SQL["term_of_codes"] = _ids("list_contains(w, 'frozen')")
SQL["term_of_delimited"] = "select distinct doc_id, cast(1.0 as double) as score from book_paragraph where list_contains(string_split(id, '-'), '7') or id = '4000-3'"
SQL["token_offsets"] = r"""
  with t as (select doc_id, regexp_extract_all(text, '\S+') as w, regexp_split_to_array(text, '\S+') as g from documents where text is not null),
  p as (select doc_id, w, g, unnest(range(1, len(w) + 1)) as i from t)
  select doc_id, cast(i - 1 as int) as pos, w[i] as term,
         cast(list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(w, 1, i - 1), lambda x: length(x))), 0) as int) as first,
         cast(list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + list_sum(list_transform(list_slice(w, 1, i), lambda x: length(x))) as int) as behind
  from p"""
SQL["term_vectors"] = _with("select doc_id, term, tf from tx where doc_id in (select doc_id from tx where term = 'kettle')")
_MARK = r"regexp_replace(title, '(?i)\b({0})\b', '<b>\1</b>', 'g')"
SQL["highlights_of_titles"] = f"select doc_id, {_MARK.format('morning|engine')} as snippet from documents where regexp_matches(lower(title), '\\b(morning|engi[a-z0-9]*)\\b')"
SQL["highlights_of_postings"] = f"select doc_id, {_MARK.format('mornings?|engines?')} as snippet from documents where regexp_matches(lower(title), '\\b(mornings?|engines?)\\b')"
SQL["highlights_of_phrases"] = r"select doc_id, regexp_replace(title, '(?i)\b(frozen morning)\b', '<b>\1</b>', 'g') as snippet from documents where regexp_matches(lower(title), '\bmorning\b')"
SQL["terms_of_query"] = "select * from (values ('text', 'weeks'), ('text', 'river'), ('text', 'two'), ('text', 'men'), ('text', 'harb'), ('title', 'old')) as v(field, term)"
SQL["parse_errors"] = "select query, cast(place as int) as place from (values ('(river', 6), ('a \"open', 2), ('river^', 6), ('a )', 2)) as v(query, place)"
SQL["search_text"] = _with("""select doc_id, round(sum(s), 6) as score from tx where term in ('weeks', 'kettle') group by doc_id
  having bool_or(term = 'weeks') order by sum(s) desc, doc_id limit 10""")
SQL["search_in_time"] = _with("""select doc_id, round(sum(s), 6) as score, false as part, true as none_left from tx where term in ('river', 'weeks') group by doc_id
  order by sum(s) desc, doc_id limit 10""")
SQL["similarity_own_model"] = _sum("term = 'river'", "1.0").replace(_BM25 + " as s", "2 * tf / sqrt(dl) as s")
SQL["explanation_vector"] = f"""select vec_id as doc_id, round(list_dot_product(cast(embedding as double[]), {_TARGET}), 6) as dot,
  round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as norm, round(sqrt(list_dot_product({_TARGET}, {_TARGET})), 6) as query_norm,
  round({_COS}, 6) as score from embeddings where vec_id = 7"""
SQL["vector_probed"] = SQL["vector_nearest_filtered"]
SQL["vector_recall"] = "select 'clusters' as method, true as enough"
SQL["vector_sign_bits"] = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null),
  n as (select vec_id, e, sqrt(list_dot_product(e, e)) as l from v)
  select query_id, doc_id, round(score, 6) as score from (
    select a.vec_id as query_id, b.vec_id as doc_id, list_dot_product(a.e, b.e) / (a.l * b.l) as score,
           row_number() over (partition by a.vec_id order by list_dot_product(a.e, b.e) / (a.l * b.l) desc, b.vec_id) as r
    from n a, n b where a.vec_id % 50 = 0) where r <= 10"""
SQL["added_in_parts"] = SQL["merged_indexes"]
SQL["merged_overlapping"] = SQL["merged_indexes"]
SQL["added_blocks"] = "select distinct l_orderkey as doc_id, cast(1.0 as double) as score from lineitem where l_returnflag = 'R' and l_quantity >= 49 and l_orderkey in (select o_orderkey from orders)"
SQL["compacted_index"] = _sum("term in ('harbour', 'weeks')")
SQL["sorted_first"] = "select doc_id, n_chars from documents order by n_chars nulls last, doc_id limit 15"
SQL["index_check_damaged"] = _with("""select * from (
  select 'posting without document' as problem, (select count(*) from post where doc_id in (select doc_id from documents where source = 'ferry_wire'))
    + (select count(*) from documents where source = 'ferry_wire') as rows
  union all select 'document listed twice', count(*) from documents where doc_id % 7 = 0 and coalesce(source, '') <> 'ferry_wire') where rows > 0""")


def _first(most: int, body: str) -> str:
    """A query on the documents with ids up to a number."""
    return _with(body).replace("from documents", f"from (select * from documents where doc_id <= {most})")


SQL["committed_index"] = _first(500, "select doc_id, round(s, 6) as score from tx where term = 'weeks'")
SQL["restored_backup"] = _first(500, "select doc_id, round(sum(s), 6) as score from tx where term in ('river', 'weeks') group by doc_id")
SQL["snapshot_kept"] = _first(300, "select cast(v as int) as version, k as kept, (select count(*) from tx where term = 'weeks') as n from (values (1, true), (2, false), (3, true)) as x(v, k)")
SQL["index_sizes"] = "select name, true as some from (values ('corpus_stats'), ('docs'), ('postings'), ('term_stats')) as v(name)"
SQL["schema_problems"] = """select problem from (values ('missing column: gone'), ('column n_chars is bigint, not text')) as v(problem)
  union all select 'unexpected column: ' || c from (values ('lang'), ('source'), ('title'), ('fetched_at')) as v(c)"""
SQL["search_with_facets"] = _with(f""", {_HITS}, own as (select doc_id, round(score, 6) as score, source, n_chars from hits join documents using (doc_id))
  select 'hit' as kind, cast(null as varchar) as name, doc_id, score as value from (select * from own order by score desc, doc_id limit 5)
  union all select 'facet', source, -1, cast(count(*) as double) from own where source <> '' group by source
  union all select 'count', null, -1, cast(count(n_chars) as double) from own union all select 'min', null, -1, cast(min(n_chars) as double) from own
  union all select 'max', null, -1, cast(max(n_chars) as double) from own union all select 'sum', null, -1, cast(sum(n_chars) as double) from own""")
SQL["cached_query"] = _with("select doc_id, round(s, 6) as score, cast(1 as int) as found, cast(1 as int) as missed from tx where term = 'river'")
SQL["collection_filtered"] = _with(f", {_HITS} select doc_id, n_chars from hits join documents using (doc_id) where n_chars > 400 order by n_chars desc, doc_id limit 10 offset 2")
SQL["collection_ends"] = _with(f""", {_HITS}, r as (select doc_id, row_number() over (order by n_chars nulls first, doc_id) as a, row_number() over (order by n_chars desc nulls last, doc_id desc) as z
    from hits join documents using (doc_id))
  select case when a = 1 then 'first' when a = 3 then 'third' else 'last' end as which, doc_id from r where a in (1, 3) or z = 1""")
SQL["span_of_spans"] = _flat("""select distinct a.doc_id from (select * from toks where field = 'text' and term in ('two', 'three')) a
  join (select * from toks where field = 'text' and term = 'weeks') b on a.doc_id = b.doc_id and b.pos = a.pos + 1""")
SQL["streamed_twice"] = f"""
  with b as (select doc_id, case when doc_id % 3 = 0 then 'river again' else body end as v from (
               select doc_id, any_value(body) as body from book_paragraph where doc_id is not null and body is not null group by doc_id)),
  toks as (select doc_id, unnest(list_filter(list_transform({_FIND.format("v")}, lambda x: lower(x)), lambda x: x not in ({_STOPS}))) as term from b),
  st as (select term, count(distinct doc_id) as df, count(*) as cf from toks group by term)
  select term, cast(df as bigint) as df, cast(cf as bigint) as cf, (select count(*) from b) as n_docs, (select cast(sum(cf) as bigint) from st) as sum_dl
  from st where term in ('river', 'again', 'the', 'water')"""
SQL["merged_stream"] = _with("select doc_id, round(s, 6) as score from tx where term = 'river'").replace(
    "from documents", "from (select doc_id, case when doc_id % 3 = 0 then 'river again' else any_value(body) end as text, null as title from book_paragraph where doc_id is not null and body is not null group by doc_id)"
)
SQL["migrated_index"] = _first(300, "select 'current,old' as before, 'current,current,old' as after, count(*) as n from tx where term = 'weeks'")
SQL["collection_predicates"] = _with("""select distinct doc_id from tx join documents using (doc_id)
  where (term = 'weeks' or starts_with(term, 'harb')) and n_chars > 300 and coalesce(source, '') <> 'ferry_wire'
    and doc_id in (select doc_id from post where field = 'title')""")
SQL["filter_synonyms"] = r"""
  with w as (select doc_id, regexp_extract_all(lower(title), '\S+') as w from documents where title is not null),
  p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w)
  select doc_id, cast(i - 1 as int) as pos, w[i] as term from p
  union all select doc_id, cast(i - 1 as int), 'stream' from p where w[i] = 'river'
  union all select doc_id, cast(i - 1 as int), 'archive' from p where w[i] = 'old' and w[i + 1] = 'letter'"""
SQL["filter_word_delimiter"] = """select distinct doc_id, cast(0 as int) as pos, unnest(list_append(string_split(id, '-'), id)) as term from book_paragraph where id is not null"""
SQL = {k: v for k, v in SQL.items() if v}
