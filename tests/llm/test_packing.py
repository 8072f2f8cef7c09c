"""Recipes against brute force, and assignments against their rules."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import packing


def least_bins(sizes: list[int], capacity: int) -> int:
    """The optimum by search."""
    best = [len(sizes)]

    def go(i: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in sorted({r: k for k, r in enumerate(rooms)}.values()):
            if rooms[j] >= sizes[i]:
                rooms[j] -= sizes[i]
                go(i + 1, rooms)
                rooms[j] += sizes[i]
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0] if sizes else 0


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=150, deadline=None)
def test_reduction_loses_nothing(sizes):
    """Fixed containers and an optimal remainder together are optimal."""
    fixed, left = packing.reduce_instance(Counter(sizes), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(r.bins for r in fixed) + least_bins(rest, 20) == least_bins(sizes, 20)


@given(st.lists(st.integers(3, 11), min_size=6, max_size=11))
@settings(max_examples=300, deadline=None)
def test_reduction_of_several_items_a_container(sizes):
    fixed, left = packing.reduce_instance(Counter(sizes), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(r.bins for r in fixed) + least_bins(rest, 20) == least_bins(sizes, 20)


def test_reduction_keeps_triples_open():
    """Fixing {10, 7, 3} would need a fourth container."""
    sizes = [10, 7, 7, 6, 6, 6, 5, 5, 5, 3]
    fixed, left = packing.reduce_instance(Counter(sizes), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(r.bins for r in fixed) + least_bins(rest, 20) == least_bins(sizes, 20) == 3


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
@settings(max_examples=100, deadline=None)
def test_recipes_use_every_item_once(counts):
    used: Counter = Counter()
    for r in packing.plan(counts, 50):
        assert sum(r.sizes) <= 50 and r.bins > 0
        for s in r.sizes:
            used[s] += r.bins
    assert used == Counter(counts)


def test_assignment(spark):
    rows = [(i, (i * 37) % 90 + 1) for i in range(300)] + [(1000, 250), (1001, 100), (1002, 0), (1003, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(5)
    got = packing.pack(df, 100).collect()
    size, held = defaultdict(int), defaultdict(list)
    for r in got:
        size[r["container"]] += r["size"]
        held[r["doc_id"]].append((r["piece"], r["size"]))
    assert max(size.values()) <= 100
    assert {d: sum(s for _, s in p) for d, p in held.items()} == {d: t for d, t in rows if t}
    assert sorted(held[1000]) == [(0, 100), (1, 100), (2, 50)] and held[1001] == [(0, 100)]
    assert all(len(p) == 1 for d, p in held.items() if d != 1000)
    assert len(size) <= sum(t or 0 for _, t in rows) / 100 * 1.05 + 1
    report = packing.fill_report(packing.pack(df, 100), 100).first()
    assert report["containers"] == len(size) and report["tokens"] == sum(t or 0 for _, t in rows)


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), 0)
