"""Analysis on small texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.analysis import analyser as an
from folioscope.analysis import charfilters, filters, phonetic, stemmers, tokenisers
from folioscope.functions import geo, vectors
from folioscope.sources import json as js


def run(spark, make, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r["x"] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tokenisers(spark):
    assert run(spark, tokenisers.standard, "Don't stop, 2nd!", None, "") == [["Don", "t", "stop", "2nd"], [], []]
    assert run(spark, tokenisers.cjk_bigram, "漢字仮 abc 字") == [["漢字", "字仮", "abc", "字"]]
    assert run(spark, tokenisers.ngram(2, 3), "abcd", "a") == [["ab", "abc", "bc", "bcd", "cd"], []]
    assert run(spark, tokenisers.edge_ngram(1, 2), "ab c") == [["a", "ab", "c"]]
    assert run(spark, tokenisers.uax29, "see http://x.example/a. or a.b@c.example #tag") == [["see", "http://x.example/a", "or", "a.b@c.example", "#tag"]]
    wiki = run(spark, tokenisers.mediawiki_typed, "'''Bold''' [[a|link text]] == Head ==")[0]
    assert [(t["term"], t["type"]) for t in wiki] == [("Bold", "bold"), ("link", "link"), ("text", "link"), ("Head", "heading")]
    assert run(spark, tokenisers.thai(["กา", "กาแฟ"]), "กาแฟกาดี ok") == [["กาแฟ", "กา", "ดี", "ok"]]


def test_char_filters(spark):
    assert run(spark, charfilters.html_strip, "<b>a</b>&amp;c") == [" a  c"]
    assert run(spark, charfilters.mapping({"ab": "x", "a": "y"}), "aba") == ["xy"]


def test_filters(spark):
    w = tokenisers.whitespace
    assert run(spark, lambda c: filters.stop(["The"])(w(c)), "the Cat THE") == [["Cat"]]
    assert run(spark, lambda c: filters.elision()(w(c)), "l'avion qu’il d'or") == [["avion", "il", "or"]]
    assert run(spark, lambda c: filters.classic(w(c)), "U.S.A. dog's") == [["USA", "dog"]]
    assert run(spark, lambda c: filters.shingles(2, 2)(w(c)), "a b c", "a") == [["a", "b", "c", "a b", "b c"], ["a"]]
    assert run(spark, lambda c: filters.common_grams(["of", "the"])(w(c)), "of the sea") == [["of", "the", "sea", "of_the"]]
    joined = run(spark, lambda c: filters.hyphenated(filters.word_delimiter()(w(c))), "eco-nomic day")[0]
    assert [(t["term"], t["pos"]) for t in joined] == [("eco-nomic", 0), ("day", 1)]
    assert run(spark, lambda c: filters.accent_fold(w(c)), "Élan façade") == [["Elan", "facade"]]
    assert run(spark, lambda c: filters.decimal_digits(w(c)), "٣٤") == [["34"]]
    assert run(spark, lambda c: filters.mark_keywords(["Cat"], filters.lowercase)(w(c)), "Cat Dog") == [["Cat", "dog"]]
    placed = run(spark, lambda c: filters.synonyms({"new york": ["ny"]})(w(c)), "in New York now")[0]
    assert [(t["term"], t["pos"]) for t in placed] == [("in", 0), ("New", 1), ("ny", 1), ("York", 2), ("now", 3)]
    assert filters.delimited_parts("Wi-Fi2Go's", join_all=True) == ["Wi", "Fi", "2", "Go", "WiFi2Go"]
    assert filters.delimited_parts("POWERShot") == ["POWER", "Shot"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("sky", "sky"), ("triplicate", "triplic"), ("generalizations", "gener")],
)
def test_porter(word, stem):
    assert stemmers.porter(word) == stem


def test_other_stemmers():
    assert stemmers.stemmer("de")("Bedeutungen".lower()) == "bedeut"
    assert stemmers.stemmer("fr")("nationaux") == "national"
    assert stemmers.stemmer("ar")("المعلمون") == "معلم"
    assert stemmers.stemmer("ja")("x") == "x"
    assert stemmers.light_english("ponies") == "pony"
    assert stemmers.light_english("stopped") == "stop"
    k = stemmers.lexicon_stemmer(["run", "nation", "hope"])
    assert [k(w) for w in ("running", "hoping", "went", "zzzs")] == ["run", "hope", "go", "zzzs"]
    h = stemmers.Hunspell("SFX S Y 1\nSFX S 0 s .\nPFX U Y 1\nPFX U 0 un .\n", "1\ndo/US\n")
    assert h("undos") == ["do"] and h("x") == ["x"]


def test_phonetics():
    assert phonetic.metaphone("Knight") == phonetic.metaphone("night")
    assert phonetic.metaphone("phone") == "FN"
    assert len(phonetic.name_codes("Schwarz")) > 1


def test_analysers(spark):
    assert an.standard().of("The Quick FOX") == ["quick", "fox"]
    assert run(spark, an.standard().terms, "The Quick FOX", None) == [["quick", "fox"], []]
    assert run(spark, an.language("en").terms, "running foxes") == [["run", "fox"]]
    assert run(spark, an.standard().budget(1).terms, "quick fox") == [["quick"]]
    with pytest.raises(Exception, match="more than 1"):
        run(spark, an.standard().budget(1, reject=True).terms, "quick fox")


def test_geo_and_vectors(spark):
    row = spark.range(1).select(
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d"),
        geo.decode(geo.encode(F.lit(48.2), 180.0), 180.0).alias("lat"),
        vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        vectors.hamming(vectors.sign_bits(F.array(F.lit(1.0), F.lit(-1.0)), F.array(F.lit(0.0), F.lit(0.0))), F.array(F.lit(0).cast("long"))).alias("h"),
    ).first()
    assert row["d"] == pytest.approx(3.141592653589793 * 6_371_000)
    assert row["lat"] == pytest.approx(48.2, abs=1e-6)
    assert (row["zero"], row["h"]) == (0.0, 1)


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, 2.5]}, "c": true, "d": null}'), (2, "broken"), (3, None)], "doc_id long, j string")
    got = {(r["field"], r["value"], r["kind"]) for r in js.fields(df, "doc_id", "j").collect()}
    assert got == {("a.b", "1", "int64"), ("a.b", "2.5", "numeric"), ("c", "true", "string")}


def test_stream(spark, tmp_path):
    from folioscope.index.schema import FieldSpec
    from folioscope.plans.compile import Searcher
    from folioscope.query import nodes as q
    from folioscope.streaming import nrt

    schema = "doc_id long, body string"
    for i, rows in enumerate([[(1, "a fox")], [(2, "two foxes"), (3, "fox fox")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        nrt.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ix"), [FieldSpec("body")]).awaitTermination()
        index = nrt.refresh(spark, str(tmp_path / "ix"), [FieldSpec("body")])
        assert Searcher(index).count(q.TermQ("body", "fox")) == i + 1
    assert index.corpus_stats.first()["n_docs"] == 3
