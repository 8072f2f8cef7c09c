"""Results of queries kept in the executors' memory, by fingerprint."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame

from ..plans.compile import Searcher
from ..query import nodes as q


class QueryCache:
    """Keeps the hits of the most recent queries; a new index starts anew."""

    def __init__(self, searcher: Searcher, size: int = 64):
        self.searcher, self.size = searcher, size
        self.held: OrderedDict[tuple[q.Query, int | None], DataFrame] = OrderedDict()
        self.hits = self.misses = 0

    def search(self, query: q.Query, n: int | None = None) -> DataFrame:
        key = (query, n)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        found = (self.searcher.hits(query) if n is None else self.searcher.search(query, n)).persist()
        self.held[key] = found
        if len(self.held) > self.size:
            self.held.popitem(last=False)[1].unpersist()
        return found

    def renew(self, searcher: Searcher) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()
        self.searcher = searcher
