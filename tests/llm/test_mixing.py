"""Raking, shares and caps."""

from __future__ import annotations

import numpy as np
import pytest

from folioscope.llm import mixing

MIX = "mix_id string, source string, target_share double, max_repeats int"
POOL = "doc_id long, source string, lang string, topic string, tokens long"


def test_rake_meets_margins():
    cells = np.array([10.0, 20, 30, 40])
    a, b = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    x = mixing.rake(cells, [a, b], [np.array([60.0, 40]), np.array([50.0, 50])])
    assert np.bincount(a, x) == pytest.approx([60, 40]) and np.bincount(b, x) == pytest.approx([50, 50], rel=1e-4)
    # ratios of the table are kept
    assert x[0] * x[3] / (x[1] * x[2]) == pytest.approx(10 * 40 / (20 * 30), rel=1e-4)


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(i, "big", "en" if i % 3 else "de", "prose", 20 + i % 7) for i in range(3000)]
    rows += [(10_000 + i, "small", "en", "wire", 30) for i in range(100)] + [(20_000, "tiny", "en", "prose", 50)]
    return spark.createDataFrame(rows, POOL)


def test_shares(spark, pool):
    target = spark.createDataFrame([("m", "big", 0.6, 2), ("m", "small", 0.3, 10), ("m", "tiny", 0.1, 3), ("m", "big", 0.6, 2), ("m", None, 0.5, 1), ("n", "gone", 1.0, 2)], MIX)
    chosen, report = mixing.mix(pool, target)
    got = {(r["mix_id"], r["source"]): r for r in mixing.shares(chosen, report).collect()}
    assert {k for k, r in got.items() if not r["reachable"]} == {("m", "tiny")}
    for (_, s), r in got.items():
        assert r["most_uses"] <= r["max_repeats"]
        if s != "gone":
            assert r["chosen_tokens"] == pytest.approx(r["goal_tokens"], abs=60)
    assert got[("m", "tiny")]["chosen_tokens"] == 150
    assert chosen.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0


def test_choice_does_not_depend_on_partitions(spark, pool):
    target = spark.createDataFrame([("m", "big", 0.7, 2), ("m", "small", 0.3, 10)], MIX)
    one = {(r["doc_id"], r["uses"]) for r in mixing.mix(pool, target)[0].collect()}
    assert one == {(r["doc_id"], r["uses"]) for r in mixing.mix(pool.repartition(7, "tokens"), target)[0].collect()}


def test_empty(spark, pool):
    target = spark.createDataFrame([("m", "big", 1.0, 2)], MIX)
    chosen, report = mixing.mix(pool.where("false"), target)
    assert chosen.count() == 0 and report.count() == 1
    chosen, report = mixing.mix(pool, target.where("false"))
    assert chosen.count() == 0 and report.count() == 0


def test_pool(spark):
    rows = [(1, "a b c", "s", "EN-us"), (1, "a b c", "s", "EN-us"), (2, None, "s", "en"), (3, "", "s", "en"), (4, "x. y", None, "en"), (5, "Title: t\n\nz.", "s", None)]
    got = {r["doc_id"]: r for r in mixing.pool(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, tokens int")).collect()}
    assert set(got) == {1, 5}
    assert (got[1]["lang"], got[5]["lang"], got[5]["topic"]) == ("en", "und", "issue") and got[1]["tokens"] == 3


def test_scarce_source_makes_the_mix_smaller(spark, pool):
    """All shares are met at the largest size at which the scarce source has its own."""
    target = spark.createDataFrame([("m", "big", 0.7, 2), ("m", "small", 0.3, 5), ("n", "big", 0.9, 2), ("n", "tiny", 0.1, 3), ("g", "big", 0.5, 2), ("g", "gone", 0.5, 2)], MIX)
    chosen, report = mixing.mix(pool, target)
    got = {(r["mix_id"], r["source"]): r for r in mixing.shares(chosen, report).collect()}
    assert all(r["settled"] for r in got.values())
    assert not got[("m", "small")]["reachable"] and got[("m", "small")]["chosen_tokens"] == 15_000
    assert got[("m", "big")]["share"] == pytest.approx(0.7, abs=0.002) and got[("m", "small")]["share"] == pytest.approx(0.3, abs=0.002)
    # a single tiny document does not shrink the mix below a tenth of its pool
    size = got[("n", "big")]["available"] + got[("n", "tiny")]["available"]
    assert got[("n", "big")]["goal_tokens"] == pytest.approx(0.9 * mixing.LEAST_SIZE * size)
    assert got[("n", "tiny")]["chosen_tokens"] == 150
    assert got[("g", "big")]["share"] == 1.0 and got[("g", "big")]["pool_share"] == pytest.approx(1.0, abs=0.002)


def test_raking_says_whether_it_settled():
    one = np.array([0, 0, 1, 1])
    two = np.array([0, 1, 0, 1])
    x, settled = mixing.raked(np.array([1.0, 2, 3, 4]), [one, two], [np.array([5.0, 5]), np.array([3.0, 7])], rounds=1)
    assert not settled and x.sum() == pytest.approx(10)
    assert mixing.raked(np.array([1.0, 2, 3, 4]), [one, two], [np.array([5.0, 5]), np.array([3.0, 7])])[1]
