"""The set join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from folioscope.llm import near_duplicates as nd
from folioscope.llm.text import terms


def collection(n=150, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                base[rng.randrange(len(base))] = rng.choice(words)
            rng.shuffle(base)
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.choice([5, 12, 40, 150])))))
    return rows


def brute(rows, t):
    sets = {d: set(terms(x)) for d, x in rows if x and terms(x)}
    ids = sorted(sets)
    return {
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9
    }


@pytest.mark.parametrize(("boundary", "block"), [(0, 40_000), (30, 40_000), (10_000, 40_000), (0, 5), (30, 5)])
def test_all_pairs(spark, monkeypatch, boundary, block):
    """Lists alone, subsets alone, both, and with every list cut into cells."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = collection()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.pairs_of_records(*nd.similar_records(df, 0.7, boundary)).collect()
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in got} == brute(rows, 0.7)
    assert len(got) == len({(r["doc_id_a"], r["doc_id_b"]) for r in got})


def tiny_collection():
    """Pairs of 3 and 4, 4 and 5, 5 and 5, and 5 and 7 terms, each pair with words of its own."""
    rng, rows = random.Random(5), []
    for v in range(160):
        a, b = ((3, 4), (4, 5), (5, 5), (5, 7))[v % 4]
        words = [f"v{v}x{i}" for i in range(b)]
        other = [*words[1:], f"v{v}y"] if a == b else words[:a]
        for text in (words, other):
            rows.append((len(rows), " ".join(rng.sample(text, len(text)))))
    shared = ["same", "problem", "here", "too", "again", "now"]
    for _ in range(40):
        rows.append((len(rows), " ".join(rng.sample(shared, rng.randint(1, 5)))))
    return rows


@pytest.mark.parametrize("boundary", [0, 3, 4, 5, 6, 10_000, None])
def test_pairs_of_tiny_sets(spark, boundary):
    rows = tiny_collection()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.pairs_of_records(*nd.similar_records(df, 0.7, boundary)).collect()
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in got} == brute(rows, 0.7)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a b c"), (5, "C b, A!"), (4, "a b c"), (None, "a b c"), (6, "x " * 50_000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, sig string")
    links, members = nd.similar_records(df)
    assert [(r["doc_id_a"], r["doc_id_b"]) for r in nd.pairs_of_records(links, members).collect()] == [(4, 5)]
    assert {(r["doc_id"], r["group_id"]) for r in nd.groups(links, members).collect()} == {(4, 4), (5, 4), (6, 6)}
    empty = nd.pairs_of_records(*nd.similar_records(df.where("false")))
    assert empty.count() == 0


def test_large_class_is_linked_through_its_first(spark, monkeypatch):
    monkeypatch.setattr(nd, "EXPAND", 3)
    rows = [(i, "a b c d") for i in range(6)] + [(9, "a b c d e")]
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in nd.pairs_of_records(*nd.similar_records(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {(0, i) for i in (1, 2, 3, 4, 5, 9)}


def test_large_class_of_different_texts_gives_all_pairs(spark, monkeypatch):
    """Equal term sets, each text its own, in classes of several blocks; exact copies are tied to their first."""
    monkeypatch.setattr(nd, "EXPAND", 3)
    monkeypatch.setattr(nd, "MEMBERS", 4)
    rows = [(i, "a b c d e f" + "." * i) for i in range(12)] + [(20 + i, "A b c d e f g" + "!" * i) for i in range(9)]
    rows += [(40 + i, "f e d c b a") for i in range(5)] + [(50, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in nd.pairs_of_records(*nd.similar_records(df)).collect()}
    assert got == brute([r for r in rows if not 40 < r[0] < 50], 0.7) | {(40, 40 + i) for i in range(1, 5)}


def test_chain_of_links_is_one_group(spark):
    base = [f"t{i}" for i in range(20)]
    rows = [(i, " ".join(base[i : i + 12])) for i in range(9)]
    links, members = nd.similar_records(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["group_id"] for r in nd.groups(links, members).collect()} == {0}
    with pytest.raises(RuntimeError):
        nd.groups(links, members, rounds=1)


def test_links_count_records(spark, monkeypatch):
    """Each record's links are the records it is similar to, copies and members of other classes alike."""
    rows = [(i, "a b c d e f" + "." * i) for i in range(4)] + [(10 + i, "a b c d e f g" + "!" * i) for i in range(3)] + [(20, "x y z")]
    links, members = nd.similar_records(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["group_id"], r["links"]) for r in nd.groups(links, members).collect()}
    assert got == {**{d: (0, 6) for d in (0, 1, 2, 3, 10, 11, 12)}, 20: (20, 0)}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (10, 100, 200, 400):
        a = set(rng.integers(0, 1 << 40, n).tolist())
        b = set(list(a)[: n // 2]) | set(rng.integers(0, 1 << 40, n // 2).tolist())
        bits = [np.bincount((nd._mix(np.array(sorted(s))) >> np.uint64(54)).astype(int), minlength=1024)[None] for s in (a, b)]
        packed = [nd._pack(x) for x in bits]
        for to in (2, 4, 8, 16):
            x, y = (nd._fold(p, to) for p in packed)
            assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)
