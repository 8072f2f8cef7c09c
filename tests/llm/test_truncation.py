"""Censored fits and judged endings."""

from __future__ import annotations

import random

import numpy as np
import pytest

from folioscope.llm import truncation as tr

NOUNS = [f"{a}{b}" for a in ("fox", "oak", "mill", "red", "lead") for b in ("wood", "field", "gate", "moor", "hill")]


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(2)
    x = rng.lognormal(6.0, 0.5, 20_000)
    seen = x[x < 500]
    mu, sigma = tr.fit_censored(seen, np.ones(len(seen)), np.array([500.0]), np.array([float((x >= 500).sum())]))
    assert mu == pytest.approx(6.0, abs=0.02) and sigma == pytest.approx(0.5, abs=0.02)


def test_limits():
    rng = np.random.default_rng(3)
    x = np.minimum(rng.lognormal(6.0, 0.5, 5000).astype(int), 700)
    v, n = np.unique(x, return_counts=True)
    (limit, count, expected, _, _, settled), = tr.source_limits(v, n)
    assert settled and limit == 700 and count > 300 and expected < 10
    assert tr.source_limits(np.array([], int), np.array([], int)) == []


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} had never seen the {rng.choice(NOUNS)}."


def test_detect(spark):
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(sentence(rng) for _ in range(rng.randint(2, 16)))
        source = ("short", "free")[i % 2]
        if source == "short" and len(text) > 500:
            text = text[:500]
            cut.add(i)
        elif i % 23 == 0:
            text = text[: rng.randint(60, len(text) - 3)]
            cut.add(i)
        elif i % 5 == 0:
            text += "\n\nTHE END"
        rows.append((i, text, source, None if i % 7 else len(text), "x"))
    cut = {i for i in cut if rows[i][1].rstrip()[-1] not in ".!?"}
    rows += [(900, None, "free", 5, "x"), (901, "", None, None, "x"), (902, "  ", None, None, "x"), (3, rows[3][1], rows[3][2], rows[3][3], "x"), (None, "the", "free", 1, "x")]
    judged, limits = tr.detect(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, kind string"))
    got = {r["doc_id"] for r in judged.where("cut").collect()}
    assert len(got & cut) / len(cut) > 0.95 and len(got - cut) <= 2
    assert judged.count() == 601
    assert 500 in {r["limit"] for r in limits.where("source = 'short' and measure = 'chars'").collect()}
    rates = {r["source"]: r for r in tr.rates(judged).collect()}
    assert rates["short"]["rate"] > rates["free"]["rate"]


def test_copies_are_one_piece_of_evidence(spark):
    """Copies of a cut text are all cut; copies of a whole one are not."""
    rng = random.Random(6)
    rows = [(i, " ".join(sentence(rng) for _ in range(rng.randint(2, 16))), "free", None) for i in range(400)]
    cut = "\n".join(sentence(rng) for _ in range(6)) + "\nThe foxwood of the oakmoor had nev"
    whole = " ".join(sentence(rng) for _ in range(7))
    rows += [(1000 + i, cut + " " * (i % 3), "free", None) for i in range(200)]
    rows += [(2000 + i, whole, "free", None) for i in range(200)]
    judged, limits = tr.detect(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"))
    assert {r["doc_id"] for r in judged.where("cut").collect()} == set(range(1000, 1200))
    assert limits.where("texts > 100").count() == 0


def test_endings():
    assert tr.ending("A sentence. (more at noon)")["last"] == "(more at noon)"
    assert tr.ending("x\n```\ncode")["kind"] == "open-code"
    assert tr.ending("one two\nthree four\nfi")["short"]
    assert tr.ending("Text that stops in…")["bare_chars"] == 18
    assert tr._repaired("Ã©t") == 2


def test_nothing(spark):
    judged, limits = tr.detect(spark.createDataFrame([], "doc_id long, text string, source string, n_chars long"))
    assert judged.count() == 0 and limits.count() == 0


def test_whole_ends_of_texts_are_read():
    """A long closing line cut inside is not the line; an open bracket counts wherever it stands."""
    line = "This text may be copied by all who name its source, " * 4 + "without any fee."
    assert tr.ending("x\n" + line)["last"] != tr.ending("x\n" + line[:180])["last"]
    assert tr.ending("see (the " + "word " * 200 + "end")["open"]


def test_learning_lowers_odds():
    """Endings that are as usual among texts at limits as elsewhere say nothing; the rate away from limits is learnt."""
    row = lambda kind, odds, n: dict(kind=kind, marks="", told="none", stated="fits", odds=odds, n=n)
    learnt = tr.learn([row("word", 6.0, 500), row("stop", 6.0, 10), row("stop", None, 9000), row("list", None, 500), row("word", None, 20)])
    assert learnt.settled and learnt.rate < -4.5
    assert learnt.forms[("word", "")] > 4 and learnt.forms[("list", "")] < -1 and learnt.forms[("stop", "")] < -3
    assert tr.learn([]).settled
