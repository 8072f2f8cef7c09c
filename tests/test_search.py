"""Scores against hand computation, and relations between queries."""

from __future__ import annotations

import math

import pytest

from folioscope.functions import similarity
from folioscope.index import build as ix
from folioscope.index import maintain
from folioscope.index.schema import FieldSpec, Schema, schema_of
from folioscope.operators import positional, vector_index
from folioscope.plans.compile import Searcher
from folioscope.query import nodes as q
from folioscope.query.collection import Collection
from folioscope.query.parser import Parser, QueryError
from folioscope.results import collect, suggest
from folioscope.results.cache import QueryCache
from folioscope.results.highlight import query_terms, snippet

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog", "red", 10.0, [1.0, 0.0]),
    (2, "a quick red fox and a slow brown dog", "blue", None, [0.0, 1.0]),
    (3, "dogs and foxes are animals", "red", 3.0, [1.0, 1.0]),
    (4, None, None, 7.0, None),
    (5, "", "blue", 12.5, [0.0, 0.0]),
    (6, "brown brown brown fox", "red", 4.0, [2.0, 0.1]),
]
T = lambda t: q.TermQ("body", t)


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, body string, colour string, price double, emb array<double>")
    return ix.build(df, [FieldSpec("body"), FieldSpec("colour", kind="string")]).staged()


def ids(df):
    return [r["doc_id"] for r in df.orderBy("doc_id").collect()]


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_bm25_by_hand(index):
    got = scores(Searcher(index).hits(T("fox")))
    n, df = 6, 3
    lengths = {1: 7, 2: 6, 6: 4}  # without stop words
    avg = sum([7, 6, 3, 0, 0, 4]) / 6
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    for doc, dl in lengths.items():
        assert got[doc] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg)))
    assert set(got) == set(lengths)


def test_sets_of_hits(index):
    s = Searcher(index)
    both = ids(s.hits(T("fox") & T("brown")))
    assert both == [1, 2, 6]
    assert set(ids(s.hits(q.PhraseQ("body", ("brown", "fox"))))) <= set(both)
    assert ids(s.hits(q.PhraseQ("body", ("brown", "fox")))) == [1, 6]
    assert ids(s.hits(q.PhraseQ("body", ("fox", "brown"), 4))) == [1, 2, 6]
    assert ids(s.hits(~T("fox"))) == [3, 4, 5]
    assert ids(s.hits(q.Bool(must_not=(T("fox"),), strict=True))) == []
    assert ids(s.hits(q.PrefixQ("body", "fox") & ~T("foxes"))) == [1, 2, 6]
    assert ids(s.hits(q.WildcardQ("body", "f*s"))) == [3]
    assert ids(s.hits(q.FuzzyQ("body", "fxo", 2, 5))) == [1, 2, 6]
    assert ids(s.hits(q.ExistsQ("price"))) == [1, 3, 4, 5, 6]
    assert ids(s.hits(q.RangeQ("price", 4.0, 10.0))) == [1, 4, 6]
    assert ids(s.hits(q.or_(T("fox"), T("dog"), T("lazy"), least=2))) == [1, 2]


def test_terms_at_once_equal_clauses_apart(index):
    s = Searcher(index)
    fast = q.Bool(must=(T("brown"),), should=(T("dog").boosted(2.0),), must_not=(T("lazy"),))
    slow = q.Bool(must=(q.PrefixQ("body", "brow"),), should=(T("dog").boosted(2.0),), must_not=(T("lazy"),))
    assert scores(s.hits(fast)) == pytest.approx(scores(s.hits(slow)))


@pytest.mark.parametrize("model", ["bm25", "lm_dirichlet"])
def test_many_queries_equal_single_ones(index, spark, model):
    """With scores that allow pruning, and with negative ones that do not."""
    s = Searcher(index, similarity.SIMILARITIES[model]())
    bags = {1: ["fox"], 2: ["fox", "brown", "dog"], 3: ["zebra", "lazy"], 4: ["brown", "quick"]}
    asked = spark.createDataFrame([(i, t) for i, ts in bags.items() for t in ts] + [(None, "fox"), (5, None)], "query_id long, term string")
    for n in (1, 2, 10):
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in s.search_many(asked, "body", n).collect()}
        want = {}
        for i, ts in bags.items():
            want |= {(i, r["doc_id"]): r["score"] for r in s.search(q.or_(*map(T, ts)), n).collect()}
        assert got == pytest.approx(want)


def _shuffled(spark, run):
    """Rows that are shuffled while ``run`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    rows = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = rows()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, rows() - before


def test_many_queries_shuffle_no_pairs(spark):
    """300 queries of two terms that 400 documents have: 120,000 pairs."""
    docs = spark.createDataFrame([(i, "fox " * (1 + i % 7) + "dog " * (1 + i % 5) + "x " * (i % 11)) for i in range(400)], "doc_id long, body string")
    asked = spark.range(300).selectExpr("id as query_id", "explode(array('fox', 'dog')) as term")
    s = Searcher(ix.build(docs, [FieldSpec("body")]).staged())
    got, moved = _shuffled(spark, lambda: s.search_many(asked, "body", 2).collect())
    best = scores(s.search(T("fox") | T("dog"), 2))
    assert len(got) == 600 and moved < 20_000
    assert all(best[r["doc_id"]] == pytest.approx(r["score"]) for r in got)


def test_many_queries_where_ids_come_again(spark):
    """Two rows of one id are one document, so they don't push others out."""
    docs = spark.createDataFrame([(1, "fox fox"), (1, "fox fox"), (2, "fox and much else that is long")], "doc_id long, body string")
    s = Searcher(ix.build(docs, [FieldSpec("body")]).staged())
    asked = spark.createDataFrame([(7, "fox")], "query_id long, term string")
    assert [r["doc_id"] for r in s.search_many(asked, "body", 2).orderBy("doc_id").collect()] == [1, 2]


@pytest.mark.parametrize("parts", [1, 5])
def test_bags_of_many_terms_in_parts(spark, monkeypatch, parts):
    """Bags of one to seven terms, common and rare, against all sums, in one cell and in many."""
    import random

    from folioscope.operators import batch

    monkeypatch.setattr(batch, "CELL_BAGS", 40 if parts > 1 else 10**6)
    monkeypatch.setattr(batch, "CELL_POSTINGS", 500 if parts > 1 else 10**6)
    rnd = random.Random(3)
    rows = [(t, d, round(rnd.expovariate(1.0) * (1 + t % 5) ** 2, 1)) for t in range(20) for d in range(250) if rnd.random() < (0.6, 0.3, 0.1, 0.02)[t % 4]]
    bags = [(b, sorted(rnd.sample(range(22), rnd.randint(1, 7)))) for b in range(100)]
    found = batch.best_of_parts(spark.createDataFrame(rows, "term_id long, doc_id long, score double"), spark.createDataFrame(bags, "bag_id long, bag array<long>"), 3, len(rows), len(bags))
    got: dict[int, list] = {}
    for r in found.collect():
        got.setdefault(r["bag_id"], []).append((-r["score"], r["doc_id"]))
    for b, terms in bags:
        sums: dict[int, float] = {}
        for t in terms:
            for t2, d, x in rows:
                if t2 == t:
                    sums[d] = sums.get(d, 0.0) + x
        want = sorted((-x, d) for d, x in sums.items())[:3]
        assert sorted(got.get(b, []))[:3] == want


def test_narrowed_index_scores_as_the_whole(index, spark):
    docs = spark.createDataFrame(DOCS + [(None, "fox", "red", 1.0, None)], "doc_id long, body string, colour string, price double, emb array<double>")
    own = ix.narrowed(docs, FieldSpec("body"), spark.createDataFrame([("fox",), ("dog",), (None,), ("zebra",)], "term string"))
    asked = spark.createDataFrame([(1, "fox"), (2, "fox"), (2, "dog"), (3, "zebra")], "query_id long, term string")
    rows = lambda i: sorted(map(tuple, Searcher(i).search_many(asked, "body", 2).collect()))
    assert rows(own) == rows(index) and len(rows(own)) == 4
    assert own.corpus["body"] == index.corpus["body"] and {r["term"] for r in own.postings.collect()} == {"fox", "dog"}
    none = ix.narrowed(docs.where("false"), FieldSpec("body"), docs.select(docs.body.alias("term")))
    assert Searcher(none).search_many(asked, "body", 2).count() == 0


def test_dis_max_and_fusion(index):
    s = Searcher(index)
    a, b = scores(s.hits(T("fox"))), scores(s.hits(T("brown")))
    got = scores(s.hits(q.DisMaxQ((T("fox"), T("brown")), 0.5)))
    for d in got:
        x = [v[d] for v in (a, b) if d in v]
        assert got[d] == pytest.approx(max(x) + 0.5 * (sum(x) - max(x)))
    rrf = scores(s.hits(q.RrfQ((T("fox"), T("brown")), 60)))
    order = sorted(a, key=lambda d: (-a[d], d)), sorted(b, key=lambda d: (-b[d], d))
    for d in rrf:
        assert rrf[d] == pytest.approx(sum(1 / (61 + o.index(d)) for o in order if d in o))


def test_more_like_this_leaves_the_source_out(index):
    found = ids(Searcher(index).hits(q.LikeQ(1, ("body",))))
    assert 1 not in found and found


def test_every_similarity_scores(index):
    for name, make in similarity.SIMILARITIES.items():
        got = scores(Searcher(index, make()).hits(T("fox")))
        assert set(got) == {1, 2, 6}, name
        assert all(math.isfinite(v) for v in got.values())


def test_intervals():
    places = {"a": [0, 5], "b": [2, 7], "c": [3]}
    ordered = q.IOrdered((q.ITerm("a"), q.ITerm("b")), 1)
    assert positional.spans_of(ordered, places) == [(0, 3), (5, 8)]
    assert positional.spans_of(q.INotContaining(q.IOrdered((q.ITerm("a"), q.ITerm("b")), 9), q.ITerm("c")), places) == [(0, 3), (5, 8)]
    assert positional.spans_of(q.IContainedBy(q.ITerm("c"), q.IUnordered((q.ITerm("b"), q.ITerm("a")), 3)), places) == [(3, 4)]


def test_vectors(index, spark):
    s = Searcher(index)
    top = s.search(q.VectorQ("emb", (1.0, 0.0), 2), 2).collect()
    assert [r["doc_id"] for r in top] == [1, 6]
    assert ids(s.hits(q.VectorQ("emb", (1.0, 0.0), 2, q.TermQ("colour", "blue")))) == [2, 5]


def test_cluster_recall(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 16)) + rng.normal(size=(8, 16)).repeat(100, 0) * 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>")
    asked = df.where("doc_id % 50 = 0").selectExpr("doc_id as query_id", "v as vector")
    got = vector_index.cluster(df, "v", 16).search(asked, 10, 6).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for i in range(0, 800, 50):
        want = set(np.argsort(-(unit @ unit[i]), kind="stable")[:10].tolist())
        have = {r["doc_id"] for r in got if r["query_id"] == i}
        hit, total = hit + len(want & have), total + 10
    assert hit / total >= 0.9


def test_sign_bits_recall(spark, monkeypatch):
    """Against brute force, on data where signs say little, in one block and in several."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 48)) + 0.3
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>")
    asked = df.where("doc_id % 50 = 0").selectExpr("doc_id as query_id", "v as vector")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {(i, int(j)) for i in range(0, 1500, 50) for j in np.argsort(-(unit @ unit[i]), kind="stable")[:10]}
    for docs, queries in ((20_000, 2_000), (400, 11)):
        monkeypatch.setattr(vector_index, "SIGN_DOCS", docs)
        monkeypatch.setattr(vector_index, "SIGN_QUERIES", queries)
        got = vector_index.signs(df, "v", asked, 10).collect()
        assert {(r["query_id"], r["doc_id"]) for r in got} == want and len(got) == len(want)


def test_parser():
    p = Parser("body")
    assert p.parse("+fox -dog brown^2") == q.Bool(must=(T("fox"),), should=(T("brown").boosted(2.0),), must_not=(T("dog"),))
    assert p.parse('title:"quick fox"~3') == q.PhraseQ("title", ("quick", "fox"), 3)
    assert p.parse("fo*") == q.PrefixQ("body", "fo")
    assert p.parse("f?x~") == q.WildcardQ("body", "f?x")
    assert p.parse("foks~1") == q.FuzzyQ("body", "foks", 1)
    assert p.parse("the") == q.NoneQ("empty query")
    assert p.parse(r"well\-known") == T("well")
    with pytest.raises(QueryError) as e:
        p.parse("(fox")
    assert e.value.offset == 4
    assert Parser("body", lenient=True).parse('(fox "') == T("fox")


def test_results(index):
    hits, docs = Searcher(index).hits(T("brown")), index.docs
    assert {r["value"]: r["count"] for r in collect.facets(hits, docs, "colour").collect()} == {"red": 2, "blue": 1}
    st = collect.stats(hits, docs, "price").first()
    assert (st["count"], st["min"], st["max"], st["sum"]) == (2, 4.0, 10.0, 14.0)
    h = collect.histogram(Searcher(index).hits(q.AllQ()), docs, "price", 2.0).collect()
    assert sum(r["count"] for r in h) == 5 and any(r["count"] == 0 for r in h)
    c = collect.collapse(hits, docs, "colour", 10).collect()
    assert [r["group"] for r in c] == ["red", "blue"] and c[0]["size"] == 2
    assert [r["doc_id"] for r in collect.sort_by(hits, docs, [("price", False)], 5).collect()] == [2, 6, 1]
    none = collect.stats(Searcher(index).hits(q.NoneQ()), docs, "price").first()
    assert none["count"] == 0 and none["max"] == 0.0


def test_snippets():
    text = "one two three fox four five six seven fox eight"
    assert snippet(text, ["fox"], 20) == "...hree <b>fox</b> four five s..."
    assert snippet(text, ["zebra"], 7) == "one two..."
    assert snippet("the fox", ["the"], 50) == "the fox"
    assert query_terms(q.Bool(must=(T("a"),), must_not=(T("b"),))) == {"body": {"a"}}


def test_suggestions(index, spark):
    words = spark.createDataFrame([("foxs",), ("brwn",), (None,)], "word string")
    got = {(r["word"], r["term"]) for r in suggest.correct(index.term_stats, "body", words).collect()}
    assert ("foxs", "fox") in got and not any(w == "brwn" for w, _ in got)
    assert [r["term"] for r in suggest.complete(index.term_stats, "body", "fo").collect()] == ["fox", "foxes"]


def test_maintenance(index, spark):
    left = maintain.delete_by_term(index, "body", "lazy")
    assert ids(Searcher(left).hits(T("fox"))) == [2, 6]
    assert maintain.check(index).count() == 0
    gone = maintain.soft_delete(index, index.docs.where("doc_id = 6"))
    assert ids(Searcher(gone).hits(q.AllQ())) == [1, 2, 3, 4, 5] and gone.docs.count() == 6
    assert maintain.purge(gone, 86_400).docs.count() == 6
    more = maintain.add(index, spark.createDataFrame([(9, "fox", "red", 1.0, None)], index.docs.schema))
    assert ids(Searcher(more).hits(T("fox"))) == [1, 2, 6, 9]
    assert scores(Searcher(maintain.compact(index, 3)).hits(T("fox"))) == pytest.approx(scores(Searcher(index).hits(T("fox"))))


def test_store(index, spark, tmp_path):
    store = maintain.Store(spark, str(tmp_path / "s"), list(index.fields.values()))
    first = store.commit(index)
    second = store.commit(maintain.delete_by_term(index, "body", "lazy"))
    assert ids(Searcher(store.open()).hits(T("fox"))) == [2, 6]
    assert ids(Searcher(store.open(first)).hits(T("fox"))) == [1, 2, 6]
    store.pin(first)
    store.commit(index, keep=1)
    assert first in store.versions() and second not in store.versions()
    store.backup(str(tmp_path / "b"), first)
    other = maintain.Store(spark, str(tmp_path / "o"), list(index.fields.values()))
    assert other.restore(str(tmp_path / "b")) == first
    assert ids(Searcher(other.open()).hits(T("fox"))) == [1, 2, 6]
    assert store.sizes(first)["postings"] > 0


def test_schema(spark):
    from dataclasses import dataclass, field

    @dataclass
    class Article:
        title: str = field(metadata={"kind": "text"})
        year: int
        tags: list[str] = field(default_factory=list)

    schema = schema_of(Article, strict=True)
    assert [(f.name, f.kind, f.required) for f in schema.fields] == [("title", "text", True), ("year", "int64", True), ("tags", "string", False)]
    df = spark.createDataFrame([(1, None, 1.5)], "doc_id long, title string, year double")
    assert schema.problems(df) == ["column year is double, not int64"]
    assert [r["problem"] for r in Schema((FieldSpec("title", required=True),)).violations(df).collect()] == ["title is null"]
    with pytest.raises(ValueError):
        Schema((FieldSpec("body", required=True),)).validated(df)


def test_collection(index):
    c = Collection.of(index)
    from pyspark.sql import functions as F

    assert c.where(F.col("colour") == "red").order_by("price").skip(1).take(1).first()["doc_id"] == 6
    assert c.where(T("fox")).count() == 3
    assert c.where(T("zebra")).first(None) is None
    assert not c.where(T("zebra")).any()
    with pytest.raises(LookupError):
        c.where(T("fox")).single()


def test_cache(index):
    cache = QueryCache(Searcher(index), 1)
    assert cache.search(T("fox")).count() == 3 and cache.search(T("fox")).count() == 3
    cache.search(T("dog"))
    assert (cache.hits, cache.misses) == (1, 2) and len(cache.held) == 1


def test_empty_collection(spark):
    df = spark.createDataFrame([], "doc_id long, body string, price double")
    s = Searcher(ix.build(df, [FieldSpec("body")]))
    assert s.count(T("fox")) == 0 and s.count(q.AllQ()) == 0
    assert collect.histogram(s.hits(q.AllQ()), df, "price").count() == 0
