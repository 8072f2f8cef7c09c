"""Many bags of terms at once, over documents in parts.

A *cell* is a part of the documents, with their scored postings of the asked
terms, and a part of the bags.  All postings of a document are in one part, so
a cell adds up whole scores and gives its n best documents for each bag; pairs
of bags and documents exist only inside, one bag at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Postings and bags of a cell, about; postings that are worth a cell of their own while cores are idle.
CELL_POSTINGS, CELL_BAGS, LEAST_POSTINGS = 2_000_000, 500_000, 20_000

_BEST = "bag_id bigint, doc_id bigint, score double"


class _Lists:
    """The postings of a cell by term, each list in the order of the documents."""

    def __init__(self, table: pa.Table, n: int):
        term, doc, score = (table.column(c).to_numpy() for c in ("term_id", "doc_id", "score"))
        self.docs, at = np.unique(doc, return_inverse=True)
        self.terms, term = np.unique(term, return_inverse=True)
        key = term * len(self.docs) + at
        order = np.argsort(key, kind="stable")
        key, score = key[order], score[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first) < len(key):  # an id that several rows have is one document
            key, score = key[first], np.add.reduceat(score, first)
        cuts = np.searchsorted(key, np.arange(1, len(self.terms)) * len(self.docs))
        self.at, self.scores = np.split(key % max(1, len(self.docs)), cuts), np.split(score, cuts)
        self.top = np.array([s.max() for s in self.scores])
        self.least = np.array([s.min() for s in self.scores])
        self.nth = np.array([np.partition(s, -n)[-n] if len(s) >= n else -np.inf for s in self.scores])

    def total(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The scores of documents, added up in the order of the terms."""
        out = np.zeros(len(docs))
        for t in terms:
            at = np.minimum(np.searchsorted(self.at[t], docs), len(self.at[t]) - 1)
            out += np.where(self.at[t][at] == docs, self.scores[t][at], 0.0)
        return out


def _best(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cell's n best documents of each bag.

    The n-th best score of a term alone is one that a bag's n-th best document
    reaches at least, where no score is negative.  Terms that cannot get there
    even together are *minor*: a document with no other term of the bag is not
    among the best, so their lists are looked up and not gone through.
    """

    def run(postings: pa.Table, bags: pa.Table) -> pa.Table:
        if not postings.num_rows or not bags.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["bag_id", "doc_id", "score"])
        lists, bag_ids = _Lists(postings, n), bags.column("bag_id").to_numpy()
        asked = bags.column("bag").combine_chunks()
        owner = np.repeat(np.arange(bags.num_rows), asked.value_lengths().to_numpy())
        asked = asked.flatten().to_numpy()
        term = np.minimum(np.searchsorted(lists.terms, asked), len(lists.terms) - 1)
        here = lists.terms[term] == asked
        owner, term = owner[here], term[here]
        if not len(term):
            return run(postings.slice(0, 0), bags)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(starts[1:], len(owner))
        floor = np.where(np.minimum.reduceat(lists.least[term], starts) >= 0, np.maximum.reduceat(lists.nth[term], starts), -np.inf)
        bar = floor - 1e-9 * (1 + np.abs(np.where(np.isinf(floor), 0, floor)))  # sums in another order may be less by a trifle
        # the terms of each bag from the lowest top; minor ones come first
        rising = term[np.lexsort((lists.top[term], owner))]
        sizes = np.array([len(x) for x in lists.at])
        longest = np.maximum.reduceat(sizes[term], starts)
        pivot = np.minimum.reduceat(np.where(sizes[term] == np.repeat(longest, ends - starts), term, len(sizes)), starts)

        base = np.zeros(len(lists.docs))  # the scores of the pivot, the longest list of a bag; bags of one pivot follow each other
        sums = np.zeros(len(lists.docs))
        held = -1
        ids, found_docs, found_scores = [], [], []
        for b in np.argsort(pivot, kind="stable").tolist():
            lo, hi, p = starts[b], ends[b], pivot[b]
            if p != held:
                if held >= 0:
                    base[lists.at[held]] = sums[lists.at[held]] = 0.0
                base[lists.at[p]] = sums[lists.at[p]] = lists.scores[p]
                high = np.argsort(-lists.scores[p], kind="stable")
                falling = -lists.scores[p][high]
                held = p
            minor = int(np.searchsorted(lists.top[rising[lo:hi]].cumsum(), bar[b]))
            # what the minor terms add at most; the pivot is in every sum
            least = bar[b] - sum(lists.top[t] for t in rising[lo : lo + minor].tolist() if t != p)
            major = rising[lo + minor : hi].tolist()
            others = [t for t in major if t != p]
            parts = [lists.at[p][high[: np.searchsorted(falling, -least, "right")]]] if len(others) < len(major) else []
            if len(others) == 1:
                t = others[0]
                parts.append(lists.at[t][base[lists.at[t]] + lists.scores[t] >= least])
            elif others:
                for t in others:
                    sums[lists.at[t]] += lists.scores[t]
                parts += [lists.at[t][sums[lists.at[t]] >= least] for t in others]
                for t in others:
                    sums[lists.at[t]] = base[lists.at[t]]
            docs = np.unique(np.concatenate(parts))
            score = lists.total(term[lo:hi], docs)
            if len(docs) > n:
                first = np.lexsort((docs, -score))[:n]
                docs, score = docs[first], score[first]
            ids.append(np.full(len(docs), bag_ids[owner[lo]]))
            found_docs.append(docs)
            found_scores.append(score)
        docs = lists.docs[np.concatenate(found_docs)]
        return pa.table([pa.array(np.concatenate(ids)), pa.array(docs), pa.array(np.concatenate(found_scores))], ["bag_id", "doc_id", "score"])

    return run


def best_of_parts(postings: DataFrame, bags: DataFrame, n: int, n_postings: int, n_bags: int) -> DataFrame:
    """``(bag_id, doc_id, score)``: the n best documents of each part of the documents for each bag.

    ``postings`` is ``(term_id, doc_id, score)``, about ``n_postings`` rows;
    ``bags`` is ``(bag_id, bag)``, ``bag`` being an array of term ids.
    """
    cores = postings.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n_postings // CELL_POSTINGS), min(cores, n_postings // LEAST_POSTINGS), 1)
    groups = max(-(-n_bags // CELL_BAGS), 1)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = postings.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("group", every(groups))
    asked = bags.withColumn("group", F.pmod(F.xxhash64("bag_id"), F.lit(groups)).cast("int")).withColumn("part", every(parts))
    return rows.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInArrow(_best(n), _BEST)
