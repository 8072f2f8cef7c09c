"""Term counts and scores against brute force."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import distinctive, term_counts
from folioscope.llm.text import _TERM, terms

TEXTS = [(1, "red red red fox"), (2, "fox blue"), (3, None), (4, ""), (1, "red red red fox"), (5, "Fox  ÉCOLE école 42"), (None, "fox")]
SCHEMA = "doc_id long, text string, term string"


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_fast_path_equals_pattern(text):
    assert terms(text) == _TERM.findall(text.lower())


def records(spark, rows=TEXTS):
    # a column that clashes with the operators' own names
    return spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)


def test_counts(spark):
    own = term_counts.text_records(records(spark), "doc_id", "text")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts.text_term_counts(own, "text").collect()}
    assert got == {"red": (3, 1), "fox": (3, 3), "blue": (1, 1), "école": (2, 1), "42": (1, 1)}
    marked = term_counts.mark_terms(term_counts.text_term_counts(own, "text"), term_counts.count_records(own), 1, 0.5)
    assert {r["term"]: r["mark"] for r in marked.collect()} == {"red": "rare", "fox": "common", "blue": "rare", "école": "rare", "42": "rare"}


def test_counts_of_nothing(spark):
    none = records(spark, [])
    assert term_counts.text_term_counts(none, "text").count() == 0
    assert distinctive.distinctive_terms(none).count() == 0


def test_long_text(spark):
    long = records(spark, [(1, "ab " * 200_000)])
    assert term_counts.text_term_counts(long, "text").first()["occurrences"] == 200_000


def test_postings(spark):
    rows = [("a", 1, 2), ("a", 1, 2), ("a", 2, 0), ("a", 3, None), (None, 1, 3), ("b", None, 1), ("b", 1, 5)]
    df = spark.createDataFrame(rows, "term string, doc_id long, frequency int")
    once, counts = term_counts.posting_term_counts(df)
    assert {(r["term"], r["occurrences"], r["records"]) for r in counts.collect()} == {("a", 2, 1), ("b", 5, 1)}
    assert once.count() == 2
    got = {r["term"]: r for r in distinctive.distinctive_postings(df).collect()}
    assert got["a"]["record_terms"] == 7 and got["a"]["z"] is not None


@pytest.mark.parametrize("heavy", [1, 20_000])
def test_scores(spark, monkeypatch, heavy):
    """With every term broadcast, and with every term joined by a shuffle."""
    monkeypatch.setattr(distinctive, "HEAVY_TERMS", heavy)
    rows = [(1, "red red red fox"), (2, "fox blue"), (5, "fox red")]
    got = {(r["doc_id"], r["term"]): r["z"] for r in distinctive.distinctive_terms(records(spark, rows), prior=10.0).collect()}
    own = {d: Counter(t.split()) for d, t in rows}
    whole = sum(own.values(), Counter())
    total = sum(whole.values())
    assert len(got) == sum(map(len, own.values()))
    for d, c in own.items():
        for t, y in c.items():
            n, a = sum(c.values()), 10.0 * whole[t] / total
            rest = whole[t] - y + a
            delta = math.log((y + a) / (n + 10 - y - a)) - math.log(rest / (total - n + 10 - rest))
            assert got[(d, t)] == pytest.approx(delta / math.sqrt(1 / (y + a) + 1 / rest))


def test_bounds(spark):
    rows = [(i, "common rare rare" if i < 2 else "common") for i in range(5)]
    got = distinctive.distinctive_terms(records(spark, rows), min_count=2, max_records=3)
    assert {(r["doc_id"], r["term"]) for r in got.collect()} == {(0, "rare"), (1, "rare")}
    assert got.where(F.col("z") > 0).count() == 2
