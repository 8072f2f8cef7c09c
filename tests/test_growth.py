"""Token streams, merge policies, predicates and streams that repeat documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.analysis import analyser as an
from folioscope.analysis import streams
from folioscope.index import build as ix
from folioscope.index import cli, maintain, segments
from folioscope.index.schema import FieldSpec
from folioscope.plans.compile import Searcher
from folioscope.query import nodes as q
from folioscope.query.fields import Fields
from folioscope.results import collect, highlight
from folioscope.streaming import nrt

SYNONYMS = an.streamed(streams.whitespace, streams.lowercase, streams.synonyms({"new york": ["ny"], "big": ["large", "huge"]}))
FIELDS = [FieldSpec("body", analyser=SYNONYMS, offsets=True), FieldSpec("tag", kind="string")]


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_positions():
    tokens = SYNONYMS.stream("In New York big")
    assert [(t[0], p) for t, p in zip(tokens, streams.positions(tokens))] == [("in", 0), ("new", 1), ("ny", 1), ("york", 2), ("big", 3), ("large", 3), ("huge", 3)]
    assert [t[2:4] for t in tokens][2] == (3, 11)
    grams = streams.chain(streams.whitespace, streams.shingles(2, 2, unigrams=False))("a b c")
    assert [(t[0], p) for t, p in zip(grams, streams.positions(grams))] == [("a b", 0), ("b c", 1)]
    assert streams.cached(streams.whitespace, 1)("x y") == streams.whitespace("x y")
    with pytest.raises(ValueError, match="more than 1"):
        streams.limit(1, reject=True)(streams.whitespace("a b"))


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, "a big house in New York", "x"), (2, "big and new", "y"), (3, None, None), (4, "", "x"), (5, "york new big", "y")]
    return ix.build(spark.createDataFrame(rows, "doc_id long, body string, tag string"), FIELDS).staged()


def test_phrases_of_added_terms(index):
    s = Searcher(index)
    assert ids(s.hits(q.PhraseQ("body", ("large", "house")))) == [1]
    assert ids(s.hits(q.PhraseQ("body", ("in", "ny")))) == [1]
    assert ids(s.hits(q.TermQ("body", "huge"))) == [1, 2, 5]
    assert ids(s.search_text("+huge -ny", "body")) == [2, 5]


def test_offsets(index):
    s = Searcher(index)
    asked = q.TermQ("body", "ny") | q.TermQ("body", "huge")
    got = {r["doc_id"]: r["snippet"] for r in highlight.highlight_postings(s.hits(q.AllQ()), index, asked, "body").collect()}
    assert got == {1: "a <b>big</b> house in <b>New York</b>", 2: "<b>big</b> and new", 3: None, 4: "", 5: "york new <b>big</b>"}
    phrase = q.PhraseQ("body", ("new", "york"))
    got = {r["doc_id"]: r["snippet"] for r in highlight.highlight_postings(s.hits(q.TermQ("body", "big")), index, phrase, "body", as_phrases=True).collect()}
    assert got[1] == "a big house in <b>New York</b>" and got[5] == "york new big"
    with pytest.raises(ValueError, match="no offsets"):
        ix.postings_of(index.docs, [FieldSpec("body", analyser=an.Analyser(lambda c: F.split(c, " ")), offsets=True)])


def test_analyser_without_a_python_form(spark, index):
    own = ix.build(index.docs, [FieldSpec("body", analyser=an.Analyser(lambda c: F.split(c, " ")))])
    assert ids(Searcher(own).hits(q.PhraseQ("body", ("big", "house")))) == [1]


def test_predicates(index):
    s, f = Searcher(index), Fields(index.fields)
    assert ids(s.hits(f.tag == "x")) == [1, 4]
    assert ids(s.hits((f.tag != "x") & f.body.has("big"))) == [2, 5]
    assert ids(s.hits(f.doc_id > 2)) == [3, 4, 5] and ids(s.hits(f.doc_id < 2)) == [1]
    assert ids(s.hits(f.doc_id.between(2, 3) | f.doc_id.isin(5))) == [2, 3, 5]
    assert ids(s.hits(f.body == "big house")) == [1] and ids(s.hits(f.tag >= "y")) == [2, 5]
    assert ids(s.hits(f.body.endswith("rge") & ~f.body.contains("yor"))) == [2]
    assert ids(s.hits(f.tag == None)) == [3]  # noqa: E711


def test_one_search_for_all(index):
    got = collect.together(Searcher(index).hits(q.TermQ("body", "big")), index.docs, 2, "tag", "doc_id").collect()
    assert [r["doc_id"] for r in got if r["kind"] == "hit"] == ids(Searcher(index).search(q.TermQ("body", "big"), 2))
    assert {(r["name"], r["value"]) for r in got if r["kind"] == "facet"} == {("x", 1.0), ("y", 2.0)}
    assert {r["kind"]: r["value"] for r in got if r["kind"] in ("count", "sum")} == {"count": 3.0, "sum": 8.0}
    assert [r["doc_id"] for r in collect.first_by(index.docs, "tag", 2, descending=True).collect()] == [2, 5]


def test_policies():
    sizes = {i: 10 + i for i in range(12)}
    groups = segments.tiered(3, 3)(sizes)
    assert all(len(g) == 3 for g in groups) and len({p for g in groups for p in g}) == sum(map(len, groups))
    assert segments.tiered()({1: 5, 2: 5}) == [] and segments.tiered()({}) == []
    assert segments.log_size(3, 1)({i: (10 if i < 4 else 5000) for i in range(7)}) == [[0, 1, 2], [4, 5, 6]]
    assert segments.everything({3: 1, 1: 1}) == [[1, 3]] and segments.everything({3: 1}) == []


def test_documents_that_come_again(spark, tmp_path):
    root, fields = (tmp_path / "s").as_uri(), [FieldSpec("body")]
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, body string")
    nrt.append_batch(batch([(1, "a fox"), (2, "two fox"), (2, "two fox")]), 0, root, fields)
    nrt.append_batch(batch([(2, "a dog"), (3, "fox fox")]), 1, root, fields)
    nrt.append_batch(batch([(2, "a dog"), (3, "fox fox")]), 1, root, fields)  # replayed
    index = nrt.refresh(spark, root, fields)
    assert ids(Searcher(index).hits(q.TermQ("body", "fox"))) == [1, 3] and index.docs.count() == 3
    assert {r["term"]: (r["df"], r["cf"]) for r in index.term_stats.collect()}["fox"] == (2, 3)
    assert maintain.check(index).count() == 0
    assert nrt.merge_batches(spark, root, segments.everything) == [[0, 1]]
    nrt.append_batch(batch([(3, "dog")]), 2, root, fields)
    index = nrt.refresh(spark, root, fields)
    assert ids(Searcher(index).hits(q.TermQ("body", "dog"))) == [2, 3] and maintain.check(index).count() == 0
    assert nrt.changed(spark, root, {0, 1}) and not nrt.changed(spark, root, {-1, 2})


def test_blocks_are_whole(spark, index):
    tops = spark.createDataFrame([(10, "top", "z"), (20, "top", "z")], "doc_id long, body string, tag string")
    inner = spark.createDataFrame([(11, "small", "z", 10), (None, "lost", "z", 20), (31, "small", "z", 30)], "doc_id long, body string, tag string, parent_id long")
    made = maintain.add_blocks(index, tops, inner)
    assert ids(Searcher(made).hits(q.TermQ("tag", "z"))) == [10, 11]
    assert ids(Searcher(made).hits(q.ParentQ(q.TermQ("body", "small")))) == [10]


def test_versions(spark, index, tmp_path, capsys):
    store = maintain.Store(spark, (tmp_path / "v").as_uri(), list(index.fields.values()))
    first = store.commit(index)
    late = maintain.Store(spark, store.path, store.fields)
    head = late._head()
    store.commit(index)
    with pytest.raises(Exception, match="(?i)exist"):
        late._set(head)  # another writer was faster
    with pytest.raises(ValueError):
        store.rollback(first)
    store.backup((tmp_path / "b").as_uri(), first)
    spark.read.parquet(f"{tmp_path}/b/{first}/docs").where("doc_id > 1").write.parquet(f"{tmp_path}/b/{first}/less")
    import shutil

    shutil.rmtree(f"{tmp_path}/b/{first}/docs")
    shutil.move(f"{tmp_path}/b/{first}/less", f"{tmp_path}/b/{first}/docs")
    with pytest.raises(ValueError, match="damaged"):
        store.restore((tmp_path / "b").as_uri())
    assert cli.main(["check", store.path]) == 0 and cli.main(["prune", store.path, "1"]) == 0
    assert first in capsys.readouterr().out and store.versions() != [] and first not in store.versions()
