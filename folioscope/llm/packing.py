"""Filling containers of fixed capacity with whole items.

Method: the Martello-Toth reduction.  Taking items from the largest down, a
small set of items that provably dominates every other filling of its container
is fixed for good; the instance shrinks until nothing more can be fixed, and
best-fit packs the remainder.

Sizes are whole numbers up to the capacity, so an instance is fully described by
how many items there are of each size: a table of at most ``capacity`` rows
however large the collection.  The reduction and best-fit work on that table, on
many equal containers at once, and yield *recipes* (a multiset of sizes and how
many containers follow it).  Spark then deals the items out: items of a size are
numbered across the collection without gathering them, and a number falls in
the slot of exactly one container.

An item larger than the capacity is cut into full containers and a rest; no
other item is ever cut.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import one_row_per_id, spread, stage
from .tokens import VOCABULARY, with_tokens


@dataclass(frozen=True)
class Recipe:
    """``bins`` containers, each holding ``sizes`` (largest first)."""

    sizes: tuple[int, ...]
    bins: int
    fixed: bool


class _Sizes:
    """A multiset of sizes with ordered access."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.order[bisect.bisect_left(self.order, size)]

    def at_most(self, room: int, without: Counter) -> int | None:
        """The largest size that fits ``room``, not counting the items in ``without``."""
        i = bisect.bisect_right(self.order, room) - 1
        while i >= 0:
            s = self.order[i]
            if self.count[s] > without[s]:
                return s
            i -= 1
        return None

    def smallest(self, without: Counter, n: int, above: int = 0) -> list[int]:
        """The n smallest items larger than ``above``, not counting those in ``without``."""
        out: list[int] = []
        for s in self.order[bisect.bisect_right(self.order, above) :]:
            free = self.count[s] - without[s]
            out += [s] * min(free, n - len(out))
            if len(out) >= n:
                break
        return out


def _best_pair(items: _Sizes, room: int, without: Counter) -> tuple[int, int] | None:
    """Two further items with the largest sum that fits."""
    best: tuple[int, int, int] | None = None
    order = items.order
    lo, hi = 0, bisect.bisect_right(order, room) - 1
    while lo <= hi and hi >= 0:
        a, b = order[lo], order[hi]
        if items.count[a] <= without[a]:
            lo += 1
            continue
        if items.count[b] <= without[b]:
            hi -= 1
            continue
        if a + b > room:
            hi -= 1
            continue
        if lo == hi and items.count[a] - without[a] < 2:
            break
        if best is None or a + b > best[0]:
            best = (a + b, b, a)
            if a + b == room:
                break
        lo += 1
    return best and (best[1], best[2])


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Recipe], dict[int, int]]:
    """Fix dominating containers; what is left.

    For the largest item j, with k the largest further item that fits beside it:

    * no other item fits: {j} alone dominates;
    * j + k fills the container: {j, k} dominates;
    * no two further items fit beside j: {j, k} dominates every {j, i};
    * two may fit but no three, and k is at least as large as the best pair
      together: {j, k} dominates;
    * two may fit but no three, b is the largest that fits beside j and k, and
      no two items larger than b fit beside j: {j, k, b} dominates, as every
      pair has a larger item of at most k and a smaller one of at most b.

    A filling dominates another when the other can be parted so that each part
    is no larger than an item of its own in the first.

    Any other j stays for best-fit, and may still join a smaller item's
    container.  A rule that fixes one container holds for as many equal ones as
    the counts allow.
    """
    items = _Sizes(counts)
    fixed: list[Recipe] = []
    todo = sorted(items.order)
    while todo:
        j = todo[-1]
        choice = _dominating(items, j, capacity) if j in items.count else None
        if choice is None:
            todo.pop()
            continue
        need = Counter(choice)
        n = min(items.count[s] // m for s, m in need.items())
        for s, m in need.items():
            items.take(s, n * m)
        fixed.append(Recipe(tuple(sorted(choice, reverse=True)), n, True))
    return fixed, dict(items.count)


def _dominating(items: _Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """A filling of j's container that dominates all others, or None."""
    none: Counter = Counter({j: 1})
    room = capacity - j
    k = items.at_most(room, none)
    if k is None:
        return (j,)
    if k == room:
        return (j, k)
    least = items.smallest(none, 3)
    if len(least) < 2 or least[0] + least[1] > room:
        return (j, k)
    if len(least) > 2 and sum(least) <= room:
        return None
    pair = _best_pair(items, room, none)
    if pair is None or k >= sum(pair):
        return (j, k)
    b = items.at_most(room - k, none + Counter({k: 1}))
    if b is not None:
        larger = items.smallest(none, 2, above=b)
        if len(larger) < 2 or sum(larger) > room:
            return (j, k, b)
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[Recipe]:
    """Best-fit decreasing on counts: equal containers are filled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(room: int, sizes: tuple[int, ...], n: int) -> None:
        if room not in open_ or not open_[room]:
            i = bisect.bisect_left(rooms, room)
            if i == len(rooms) or rooms[i] != room:
                rooms.insert(i, room)
        open_[room][sizes] = open_[room].get(sizes, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = min(capacity // size, left)
                n = left // each
                put(capacity - each * size, (size,) * each, n)
                left -= n * each
                continue
            room = rooms[i]
            sizes, n = next(iter(open_[room].items()))
            each = min(room // size, left)
            used = min(n, left // each)
            if used == n:
                del open_[room][sizes]
                if not open_[room]:
                    del rooms[i]
            else:
                open_[room][sizes] = n - used
            put(room - each * size, (*sizes, *(size,) * each), used)
            left -= used * each
    return [Recipe(sizes, n, False) for room in list(open_) for sizes, n in open_[room].items()]


def plan(counts: dict[int, int], capacity: int) -> list[Recipe]:
    """Recipes for an instance, the fixed ones first."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _number(keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number the pieces of each size within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            at = []
            for s in sizes:
                at.append(seen[s])
                seen[s] += 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([part] * len(sizes), pa.int32()), pa.array(at, pa.int64())],
                [*keep, "part", "at"],
            )

    return run


def pieces_of(sized: DataFrame, capacity: int) -> DataFrame:
    """``(doc_id, piece, size)``: items up to the capacity, larger ones in parts."""
    full = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    return (
        sized.where("tokens > 0")
        .select("doc_id", "tokens", F.posexplode(F.sequence(F.lit(0), full)).alias("piece", "_p"))
        .select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("bigint").alias("size"))
    )


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            out = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                w = size == s
                lo, base, bins = slots[int(s)]
                i = np.searchsorted(lo, rank[w], "right") - 1
                out[w] = base[i] + (rank[w] - lo[i]) % bins[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("size"), pa.array(out)],
                ["doc_id", "piece", "size", "container"],
            )

    return run


def pack(sized: DataFrame, capacity: int) -> DataFrame:
    """Assign ``(doc_id, tokens)`` to containers of ``capacity`` tokens.

    Result: ``doc_id, piece, size, container``; containers are numbered from 0.
    Items of null or 0 tokens need no container and give no row; equal items
    are told apart by id only.  An item above the capacity has a row for each
    part, all but the last filling a container alone.
    """
    spark = sized.sparkSession
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = pieces_of(sized, capacity)
    numbered = stage(
        pieces.mapInArrow(_number(["doc_id", "piece", "size"]), "doc_id bigint, piece int, size bigint, part int, at bigint"), "pieces"
    )
    per_part = numbered.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    # at most `capacity` rows: one for each size that occurs
    counts = {r["size"]: r["n"] for r in offsets.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    base = 0
    for recipe in plan(counts, capacity):
        for s, m in Counter(recipe.sizes).items():
            for _ in range(m):
                slots[s].append((used[s], base, recipe.bins))
                used[s] += recipe.bins
        base += recipe.bins
    tables = {s: tuple(np.array(x, np.int64) for x in zip(*v)) for s, v in slots.items()}
    ranked = numbered.join(offsets.select("size", "part", "before"), ["size", "part"]).select(
        "doc_id", "piece", "size", (F.col("before") + F.col("at")).alias("rank")
    )
    return ranked.mapInArrow(_place(tables), "doc_id bigint, piece int, size bigint, container bigint")


def sized_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens)``, one row per id, as a stage table."""
    own = one_row_per_id(spread(documents.select("doc_id", "text")), "doc_id")
    return stage(with_tokens(own, "text", ["doc_id"], path), "sizes")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, parts, tokens, share of the space used, lower bound of containers."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("parts"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("parts").alias("parts"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
