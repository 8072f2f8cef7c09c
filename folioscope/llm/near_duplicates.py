"""Near-duplicate records: all pairs of term sets with a Jaccard similarity of at least t.

Method: a size-aware heavy-light set join.  Records are sets of distinct terms.
Terms are ordered from rare to common, so two similar sets must share terms in
short prefixes of that order.

* *Light* (small) sets enumerate fixed-size subsets: all two-term subsets that
  fall in the same of G hash groups of a prefix.  Two sets that share at least
  G + 1 prefix terms share two of one group, so no similar pair is lost.
  Sets so small that a partner may share fewer terms than that (up to 5 terms
  at t = 0.7) scan lists of single terms as well, like heavy sets.
* *Heavy* (large) sets, whose subsets would be too many, scan inverted lists:
  each prefix term is a list, and a light set that could be similar to a heavy
  one enters those lists as well.
* The boundary between the two is the set size at which the estimated cost
  (rows moved plus pairs looked at) is least; the estimate covers all sets.

Pairs that meet in a list are looked at in blocks, never emitted: a parity
sketch of 128 to 1024 bits, by the size of the set, gives a lower bound of the
symmetric difference, and only pairs the bound cannot exclude go on to the exact
count of shared terms.  Sketches fold: two of unlike length compare at the
shorter one.

Sets with equal terms form one class, of which only the smallest id takes part
in the join; its members are added to the result afterwards.  A list longer
than ``BLOCK`` is cut by size and hash into cells (see :func:`_cells`), so a
list that a third of all records share is spread over many tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package, spread, stage
from .text import terms

#: Groups of the two-term subsets.
GROUPS = 4
#: Rows of a list that one task takes at most.
BLOCK = 40_000
#: A term is common when more than this share of the records hold it.  As the
#: shares of all terms add up to the mean number of terms in a record (m), at
#: most m / COMMON terms are common, whatever the size of the collection.
COMMON = 5e-4
#: Estimated cost of one signature row, in pairs looked at.
ROW_COST = 150
#: Exact copies of one text up to this number are written out as pairs of records;
#: more are tied to the smallest id among them, from which all others follow.
EXPAND = 64
#: Members of a class that meet as many others in one task; larger classes are cut into blocks.
MEMBERS = 1000

#: Largest set whose sketch has so many words of 64 bits.
WIDTHS = ((64, 2), (128, 4), (256, 8), (1 << 40, 16))


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode()) >> 3


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    n = 0

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([held[k] for k in keys], pa.int64())], ["term", "n"]
        )
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                held.update(set(terms(text)))
                n += 1
        if len(held) > 400_000:
            yield flush()
    held["\n"] = n  # the number of texts, under a key that is no term
    yield flush()


def _encode(common: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets as sorted codes: rare terms by hash, then common ones by frequency.

    Rare terms take codes below 2**61, common ones follow in ``frequent`` as
    small integers.  A set's class is the hash of its codes; ``copy`` is the
    hash of the text itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, rare, frequent, hi, lo, copy = [], [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(terms(text))
                if not own:
                    continue
                known, other = [], []
                for term in own:
                    at = common.get(term)
                    if at is None:
                        other.append(_hash(term))
                    else:
                        known.append(at)
                known.sort()
                other.sort()
                whole = xxhash.xxh128_digest(np.asarray([*other, -1, *known], np.int64).tobytes())
                ids.append(doc)
                sizes.append(len(own))
                rare.append(other)
                frequent.append(known)
                hi.append(int.from_bytes(whole[:8], "little", signed=True))
                lo.append(int.from_bytes(whole[8:], "little", signed=True))
                copy.append(xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(rare, pa.list_(pa.int64())),
                    pa.array(frequent, pa.list_(pa.int32())),
                    pa.array(hi, pa.int64()),
                    pa.array(lo, pa.int64()),
                    pa.array(copy, pa.binary()),
                ],
                ["doc_id", "n", "rare", "frequent", "hi", "lo", "copy"],
            )

    return run


_SETS = "doc_id bigint, n int, rare array<bigint>, frequent array<int>, hi bigint, lo bigint, copy binary"


class _Flat:
    """The codes of a batch's sets in one array, set by set, rare to common."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("doc_id").to_numpy()
        self.n = batch.column("n").to_numpy().astype(np.int64)
        rare, frequent = batch.column("rare"), batch.column("frequent")
        nr = np.diff(rare.offsets.to_numpy())
        nf = np.diff(frequent.offsets.to_numpy())
        rv = rare.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        fv = frequent.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + (1 << 61)
        self.start = np.concatenate([[0], np.cumsum(nr + nf)])
        codes = np.empty(self.start[-1], np.int64)
        first = np.repeat(self.start[:-1], nr)
        codes[first + _ramp(nr)] = rv
        second = np.repeat(self.start[:-1] + nr, nf)
        codes[second + _ramp(nf)] = fv
        self.codes = codes

    def sketches(self) -> pa.Array:
        """Parity sketches as bytes: bit h % bits flips for every term."""
        bit = (_mix(self.codes) >> np.uint64(54)).astype(np.int64)
        owner = np.repeat(np.arange(len(self.n)), np.diff(self.start))
        cell = np.bincount(owner * 1024 + bit, minlength=len(self.n) * 1024) if len(self.n) <= 2000 else None
        if cell is None:
            whole = np.concatenate([self._words(i, min(i + 2000, len(self.n)), bit) for i in range(0, len(self.n), 2000)])
        else:
            whole = _pack(cell.reshape(-1, 1024))
        width = _widths(self.n)
        parts, at = np.empty(int(width.sum()), np.uint64), np.concatenate([[0], np.cumsum(width)])
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            parts[at[rows][:, None] + np.arange(w)] = _fold(whole[rows], int(w))
        return pa.BinaryArray.from_buffers(pa.binary(), len(width), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(parts)])

    def _words(self, lo: int, hi: int, bit: np.ndarray) -> np.ndarray:
        a, b = self.start[lo], self.start[hi]
        owner = np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1]))
        return _pack(np.bincount(owner * 1024 + bit[a:b], minlength=(hi - lo) * 1024).reshape(-1, 1024))


def _pack(counts: np.ndarray) -> np.ndarray:
    return np.packbits((counts & 1).astype(bool), axis=1, bitorder="little").view(np.uint64)


def _widths(n: np.ndarray) -> np.ndarray:
    return np.select([n <= most for most, _ in WIDTHS], [w for _, w in WIDTHS])


def _fold(words: np.ndarray, to: int) -> np.ndarray:
    while words.shape[1] > to:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def _prefix(n: np.ndarray, t: float, extra: int, other: int = 0) -> np.ndarray:
    """Prefix length of sets of size n whose partner is no smaller than t * n, or than ``other``."""
    least = np.ceil(t * n - 1e-9)
    if other:
        least = np.maximum(least, np.ceil(t / (1 + t) * (n + other) - 1e-9))
    return np.clip(n - least + extra, 0, n).astype(np.int64)


def _index_prefix(n: np.ndarray, t: float, extra: int) -> np.ndarray:
    """The same where the partner is at least as large."""
    return np.clip(n - np.ceil(2 * t / (1 + t) * n - 1e-9) + extra, 0, n).astype(np.int64)


def _tiny(n: np.ndarray, t: float) -> np.ndarray:
    """Sets that may be similar to one they share fewer than GROUPS + 1 terms with.

    Both sets of such a pair are tiny: its shared terms are at least t times the larger set.
    """
    return np.ceil(t * n - 1e-9) <= GROUPS


def _cost(t: float, p: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows and expected partners of each set either way, summed by set size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f = _Flat(batch)
            share = np.zeros(len(f.codes))
            isc = f.codes >= (1 << 61)
            share[isc] = p[f.codes[isc] - (1 << 61)]
            run1 = np.concatenate([[0.0], np.cumsum(share)])
            run2 = np.concatenate([[0.0], np.cumsum(share**2)])
            m1, i1 = _prefix(f.n, t, 1), _index_prefix(f.n, t, 1)
            m2, i2 = (np.where(f.n > GROUPS, x(f.n, t, GROUPS + 1), 0) for x in (_prefix, _index_prefix))
            at = f.start[:-1]
            one = run1[at + i1] - run1[at]
            s1, s2 = run1[at + i2] - run1[at], run2[at + i2] - run2[at]
            two = np.maximum(s1**2 - s2, 0) / 2 / GROUPS
            sizes, where = np.unique(f.n, return_inverse=True)
            # tiny sets scan lists either way; _boundary counts partners in subsets twice as dear
            tiny = _tiny(f.n, t)
            out = [np.bincount(where, w) for w in (m1, one, m2 * (m2 - 1) / 2 / GROUPS + m1 * tiny, two + one * tiny / 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes.astype(np.int32)), *[pa.array(x.astype(float)) for x in out]],
                ["n", "rows1", "meet1", "rows2", "meet2"],
            )

    return run


def _boundary(costs: list, sets: int) -> int:
    """The largest size whose sets enumerate subsets; 0 when none should.

    A list holds only records that have its term in their own prefix, which is
    why a term's share of all records is divided by 4, as measured.
    """
    best, at, run = 0.0, 0, 0.0
    for r in sorted(costs, key=lambda x: x["n"]):
        scan = ROW_COST * r["rows1"] + r["meet1"] * sets / 4
        subsets = ROW_COST * r["rows2"] + r["meet2"] * sets / 2
        run += subsets - scan
        if run < best:
            best, at = run, r["n"]
    return at


def _signatures(t: float, boundary: int, counting: bool) -> Callable:
    """One row per set and signature; ``counting`` gives only the length of each list."""

    def rows_of(f: _Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        light = f.n <= boundary
        parts = []
        # lists of single terms: heavy and tiny sets, and light ones near the boundary
        near = np.where(f.n >= t * (boundary + 1) - 1e-9, _prefix(f.n, t, 1, boundary + 1), 0)
        m = np.where(light & ~_tiny(f.n, t), near, _prefix(f.n, t, 1))
        i = np.minimum(_index_prefix(f.n, t, 1), m)
        owner = np.repeat(np.arange(len(f.n)), m)
        rank = _ramp(m)
        code = f.codes[f.start[:-1][owner] + rank]
        parts.append((owner, _mix(code).view(np.int64), rank < i[owner]))
        if boundary:
            # sets of up to GROUPS terms meet only tiny sets, which are all in the lists
            m = np.where(light & (f.n > GROUPS), _prefix(f.n, t, GROUPS + 1), 0)
            i = _index_prefix(f.n, t, GROUPS + 1)
            for size in np.unique(m[m > 1]):
                own = np.flatnonzero(m == size)
                grid = f.codes[f.start[:-1][own][:, None] + np.arange(size)]
                a, b = np.triu_indices(size, 1)
                group = _mix(grid) % np.uint64(GROUPS)
                same = group[:, a] == group[:, b]
                w, c = np.nonzero(same)
                with np.errstate(over="ignore"):
                    sig = _mix(grid[w, a[c]].view(np.uint64) * np.uint64(31) + _mix(grid[w, b[c]])).view(np.int64)
                parts.append((own[w], sig, b[c] < i[own[w]]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f = _Flat(batch)
            owner, sig, index = rows_of(f)
            if counting:
                keys, counts = np.unique(sig, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["sig", "rows"])
                continue
            sk = f.sketches()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sig),
                    pa.array((f.n[owner] * 2 + index).astype(np.int32)),
                    pa.array(f.ids[owner]),
                    sk.take(pa.array(owner)),
                ],
                ["sig", "size", "doc_id", "sketch"],
            )

    return run


def _cells(signed: DataFrame, long: DataFrame) -> DataFrame:
    """Copy the rows of long lists ``(sig, by)`` to the cells of a triangle.

    The rows of a list split s ways fall into s blocks by the hash of the id;
    block i meets block j in cell (i, j), i <= j, so a row has s copies and a
    cell two blocks of bounded length.  In cell (i, j) with i < j only pairs
    across the blocks are new, but seeing the others again does no harm.
    """
    block = F.pmod(F.xxhash64("doc_id"), F.col("by")).cast("int")
    spread_out = F.when(F.col("by").isNotNull(), F.sequence(F.lit(0), F.col("by") - 1)).otherwise(F.array(F.lit(-1)))
    at = signed.join(long, "sig", "left").withColumn("_i", block).withColumn("_j", F.explode(spread_out))
    cell = F.when(F.col("by").isNull(), 0).otherwise(F.least("_i", "_j") * F.col("by") + F.greatest("_i", "_j"))
    return at.select("sig", cell.alias("cell"), "size", "doc_id", "sketch")


_ROWS = "sig bigint, size int, doc_id bigint, sketch binary"


def _bound(t: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The largest symmetric difference that similar sets of these sizes may have."""
    return np.floor((1 - t) / (1 + t) * (n + m) + 1e-9)


class _Sketches:
    """Sketches of the rows at hand, folded to each length that is asked for."""

    def __init__(self, words: np.ndarray, width: np.ndarray):
        start = np.concatenate([[0], np.cumsum(width)[:-1]])
        self.width, self.level = width, {}
        present = [int(w) for w in np.unique(width)]
        for to in (2, 4, 8, 16):
            if to > present[-1]:
                break
            out = np.zeros((len(width), to), np.uint64)
            for w in present:
                if w >= to:
                    rows = np.flatnonzero(width == w)
                    out[rows] = _fold(words[start[rows][:, None] + np.arange(w)], to)
            self.level[to] = out

    def gap(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Least symmetric difference of pairs, the smaller set on the left."""
        out = np.zeros(len(left), np.int64)
        of = self.width[left]
        for w in np.unique(of):
            k = of == w
            x = self.level[int(w)]
            out[k] = np.bitwise_count(x[left[k]] ^ x[right[k]]).sum(axis=1)
        return out


def _meet(t: float) -> Callable:
    """Look at the pairs of each list; rows come sorted by list and size."""
    ratio = (1 - t) / (1 + t)

    def small(n, index, sk, starts, length):
        """All lists of one short length at once."""
        a, b = np.triu_indices(length, 1)
        left, right = (starts[:, None] + a).ravel(), (starts[:, None] + b).ravel()
        ok = index[left] & (n[left] >= t * n[right] - 1e-9)
        left, right = left[ok], right[ok]
        ok = sk.gap(left, right) <= _bound(t, n[left], n[right])
        return left[ok], right[ok]

    def large(n, index, sk, lo_, hi_):
        """One long list, in blocks; sizes ascend."""
        probes = lo_ + np.flatnonzero(index[lo_:hi_])
        own = n[lo_:hi_]
        for at in range(0, len(probes), 64):
            p = probes[at : at + 64]
            x = sk.level[max(2, int(sk.width[p[0]]) // 2)]
            hi = lo_ + int(np.searchsorted(own, np.floor(n[p[-1]] / t + 1e-9), "right"))
            xp = x[p].T[:, :, None]
            for s in range(int(p[0]) + 1, hi, 2048):
                e = min(hi, s + 2048)
                xq = x[s:e].T[:, None, :]
                far = np.bitwise_count(xp[0] ^ xq[0])
                for w in range(1, len(xp)):
                    far = far + np.bitwise_count(xp[w] ^ xq[w]) if len(xp) <= 3 else far.astype(np.uint16) + np.bitwise_count(xp[w] ^ xq[w])
                # the block's largest set gives a bound for all its pairs
                most = np.minimum(np.floor(ratio * (n[p] + n[e - 1]) + 1e-9), 65535).astype(np.uint16)
                i, j = np.nonzero(far <= most[:, None])
                if not len(i):
                    continue
                left, right = p[i], s + j
                ok = (left < right) & (n[left] >= t * n[right] - 1e-9)
                left, right = left[ok], right[ok]
                ok = sk.gap(left, right) <= _bound(t, n[left], n[right])
                yield left[ok], right[ok]

    def lists(sig, cell, size, sk):
        n, index = size >> 1, (size & 1).astype(bool)
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(sig) != 0) | (np.diff(cell) != 0)]))
        length = np.diff(np.concatenate([edge, [len(sig)]]))
        for size_ in np.unique(length[(length > 1) & (length <= 64)]):
            starts = edge[length == size_]
            step = max(1, 400_000 // int(size_ * size_))
            for s in range(0, len(starts), step):
                yield small(n, index, sk, starts[s : s + step], int(size_))
        for s, ln in zip(edge[length > 64], length[length > 64]):
            yield from large(n, index, sk, int(s), int(s + ln))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = [batch.column(i).to_numpy() for i in range(4)]
                new[2] = new[2].astype(np.int64)
                new += _words_of(batch.column(4))
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                if len(held[0]) < 150_000:
                    continue
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                cut = int(np.argmax(last))
                if cut == 0:
                    continue
                at = int(held[4][:cut].sum())
                now = [*[x[:cut] for x in held[:5]], held[5][:at]]
                held = [*[x[cut:] for x in held[:5]], held[5][at:]]
            else:
                if held is None:
                    return
                now, held = held, None
            ids = now[3]
            found = []
            for x, y in lists(now[0], now[1], now[2], _Sketches(now[5], now[4])):
                if len(x):
                    x, y = ids[x], ids[y]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _words_of(column: pa.Array) -> list[np.ndarray]:
    """Widths and words of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return [np.diff(offsets) // 8, np.ascontiguousarray(data).view(np.uint64)]


def _then_none(batches):
    yield from batches
    yield None


def similar_records(records: DataFrame, t: float = 0.7, boundary: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between classes, and the members of each class.

    ``records`` is ``(doc_id, text)``.  Returns ``links (a, b, similarity)``,
    a < b, ids of class representatives whose sets are similar but not equal,
    and ``members (rep, copy, doc_id)`` with every record that has a term;
    ``copy`` tells texts of a class apart, null where a class is one record.

    Null and empty texts, and texts without any term, belong to no class.  Of a
    doc_id whose rows hold different texts one counts, chosen by hash.
    ``boundary`` fixes the largest light set instead of the cost estimate.
    """
    spark = records.sparkSession
    ship_package(spark)
    texts = spread(records.select("doc_id", "text")).where("doc_id is not null and text is not null")
    held = stage(
        texts.select("text").mapInArrow(_count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "terms"
    )
    n_texts = held.where(F.col("term") == "\n").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    least = max(2, COMMON * n_texts)
    rows = held.where((F.col("n") >= least) & (F.col("term") != "\n")).orderBy("n", "term").collect()
    common = {r["term"]: i for i, r in enumerate(rows)}
    share = np.array([r["n"] / n_texts for r in rows] or [0.0])

    sets = stage(texts.mapInArrow(_encode(common), _SETS), "sets")
    of = F.struct("hi", "lo", "copy")
    one = sets.groupBy("doc_id").agg(F.min(of).alias("s"), F.max(of).alias("z"))
    odd = stage(one.where("s <> z").select("doc_id", F.col("s.hi").alias("_hi"), F.col("s.lo").alias("_lo")), "odd-ids")
    members = one.select("s.hi", "s.lo", "s.copy", "doc_id")
    classes = members.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    shared = stage(members.join(classes.where("size > 1"), ["hi", "lo"]).select("rep", "copy", "doc_id"), "class-members")
    spare = shared.where("rep <> doc_id").select("doc_id").distinct()
    # rows loaded twice give equal sets under one id; in the lists they meet only themselves
    reps = stage(
        sets.join(spare, "doc_id", "left_anti").join(odd, "doc_id", "left")
        .where("_hi is null or (hi = _hi and lo = _lo)").select("doc_id", "n", "rare", "frequent"),
        "representatives",
    )

    if boundary is None:
        costs = reps.mapInArrow(_cost(t, share), "n int, rows1 double, meet1 double, rows2 double, meet2 double")
        summed = costs.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("rows1", "meet1", "rows2", "meet2")]).collect()
        boundary = _boundary(summed, n_texts)
    lengths = reps.mapInArrow(_signatures(t, boundary, True), "sig bigint, rows bigint").groupBy("sig").agg(F.sum("rows").alias("rows"))
    long = stage(lengths.where(F.col("rows") > BLOCK).select("sig", (F.ceil(F.col("rows") / BLOCK) + 1).cast("int").alias("by")), "long-lists")

    signed = _cells(reps.mapInArrow(_signatures(t, boundary, False), _ROWS), long)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = signed.repartition(parts, "sig", "cell").sortWithinPartitions("sig", "cell", "size").mapInArrow(_meet(t), "a bigint, b bigint")
    candidates = stage(met.distinct(), "candidates")

    left = candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct()
    wanted = stage(
        reps.join(left, "doc_id", "left_semi").select("doc_id", "n", F.array_union("rare", F.transform("frequent", lambda x: x.cast("long") - F.lit(1 << 40))).alias("codes")),
        "candidate-sets",
    )
    x = wanted.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("codes").alias("ca"))
    y = wanted.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("cb"))
    both = F.size(F.array_intersect("ca", "cb"))
    links = (
        candidates.join(x, "a").join(y, "b")
        .select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"))
        .where(F.col("similarity") >= t - 1e-12)
        .groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    )
    own = sets.select("doc_id").distinct().join(shared, "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), F.lit(None).cast("binary").alias("copy"), "doc_id")
    everyone = own.unionByName(shared)
    return stage(links, "links"), everyone


def pairs_of_records(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(doc_id_a, doc_id_b, similarity)``, the smaller id first.

    All pairs of different texts are written out.  Exact copies of one text are
    as well up to ``EXPAND`` of them; the records of more are each paired with
    the smallest id among them, which alone meets other texts.

    Classes of more than ``MEMBERS`` records are cut into blocks, and each two
    blocks meet under a key of their own.
    """
    shared = members.where("copy is not null")
    copies = shared.groupBy("rep", "copy").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("same"))
    known = shared.join(copies, ["rep", "copy"])
    tied = known.where((F.col("same") > EXPAND) & (F.col("doc_id") != F.col("first"))).select(F.col("first").alias("x"), F.col("doc_id").alias("y"))
    meeting = known.where((F.col("same") <= EXPAND) | (F.col("doc_id") == F.col("first"))).select("rep", "doc_id")
    blocks = stage(meeting.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks")), "class-blocks")
    placed = stage(meeting.join(blocks, "rep").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "class-blocks-of")

    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    inside = (
        placed.select("rep", F.col("block").alias("i"), every.alias("j"), F.col("doc_id").alias("x"))
        .join(placed.select("rep", every.alias("i"), F.col("block").alias("j"), F.col("doc_id").alias("y")), ["rep", "i", "j"])
        .where("x < y").select("x", "y").unionByName(tied).withColumn("similarity", F.lit(1.0))
    )

    # both sides' blocks are named before either is spelt out, so a pair of keys yields one block times one block
    met = links
    for side in ("a", "b"):
        cut = blocks.select(F.col("rep").alias(side), F.col("blocks").alias("_n"))
        met = met.join(cut, side, "left").withColumn(f"_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    for side in ("a", "b"):
        own = placed.select(F.col("rep").alias(side), F.col("block").alias(f"_{side}"), F.col("doc_id").alias("_own"))
        met = met.join(own, [side, f"_{side}"], "left").withColumn(f"_{side}", F.coalesce("_own", side)).drop("_own")
    met = met.select(F.col("_a").alias("x"), F.col("_b").alias("y"), "similarity")
    return (
        inside.unionByName(met)
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "similarity")
        .where("doc_id_a < doc_id_b")
        .groupBy("doc_id_a", "doc_id_b").agg(F.max("similarity").alias("similarity"))
    )


def groups(links: DataFrame, members: DataFrame, rounds: int = 100) -> DataFrame:
    """``(doc_id, group_id, links)``: connected components of the links.

    Every record comes out once, with the smallest id of its component and the
    number of records it is similar to.  Labels are spread by alternating
    large-star and small-star steps on the edges, each a stage table, until none
    changes; the rounds they take grow with the logarithm of a component's
    size, and labels that have not settled after ``rounds`` are an error.
    """
    edges = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select("v", "m").where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("m0"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m0").alias("m")), F.struct(F.col("m").alias("v"), F.col("m0").alias("m")))).alias("e")).select("e.v", "e.m").where("v <> m").distinct()
        after = stage(small.select(F.col("m").alias("u"), F.col("v").alias("v")), "edges")
        changed = after.exceptAll(edges).limit(1).count() or edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    label = edges.groupBy(F.col("v").alias("rep")).agg(F.min("u").alias("group_id"))
    sizes = members.groupBy("rep").agg(F.count_distinct("doc_id").alias("size"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    others = sizes.select(F.col("rep").alias("other"), F.col("size").alias("_n"))
    degree = ends.join(others, "other").groupBy("rep").agg(F.sum("_n").alias("links"))
    count = F.col("size") - 1 + F.coalesce("links", F.lit(0))
    return (
        members.join(sizes, "rep").join(label, "rep", "left").join(degree, "rep", "left")
        .groupBy("doc_id").agg(F.min(F.coalesce("group_id", "rep")).alias("group_id"), F.max(count).cast("long").alias("links"))
    )
