"""A collection as a chain of steps: where, order, skip, take, select, and what ends it."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..index.build import Index
from ..plans.compile import Searcher
from . import nodes as q


@dataclass(frozen=True)
class Collection:
    """Documents of an index; every step returns a new collection."""

    searcher: Searcher
    conditions: tuple[Column | q.Query, ...] = ()
    keys: tuple[tuple[Column, bool], ...] = ()
    columns: tuple[Any, ...] = ()
    skipped: int = 0
    limit: int | None = None

    @staticmethod
    def of(index: Index) -> Collection:
        return Collection(Searcher(index))

    def where(self, condition: Column | q.Query) -> Collection:
        """Keep what a column expression or a query matches."""
        return dataclasses.replace(self, conditions=(*self.conditions, condition))

    def order_by(self, *keys: Column | str, descending: bool = False) -> Collection:
        return dataclasses.replace(self, keys=tuple((F.col(k) if isinstance(k, str) else k, descending) for k in keys))

    def order_by_descending(self, *keys: Column | str) -> Collection:
        return self.order_by(*keys, descending=True)

    def then_by(self, *keys: Column | str, descending: bool = False) -> Collection:
        return dataclasses.replace(self, keys=self.keys + self.order_by(*keys, descending=descending).keys)

    def select(self, *columns: Any) -> Collection:
        return dataclasses.replace(self, columns=columns)

    def skip(self, n: int) -> Collection:
        return dataclasses.replace(self, skipped=n)

    def take(self, n: int) -> Collection:
        return dataclasses.replace(self, limit=n)

    def _matching(self) -> tuple[DataFrame, list[tuple[Column, bool]]]:
        """What the conditions leave, and the keys of its order."""
        docs = self.searcher.index.docs
        columns = [c for c in self.conditions if isinstance(c, Column)]
        queries = [c for c in self.conditions if isinstance(c, q.Query)]
        if columns:
            docs = docs.where(reduce(lambda a, b: a & b, columns))
        order = list(self.keys)
        if queries:
            docs = docs.join(self.searcher.hits(queries[0] if len(queries) == 1 else q.and_(*queries)), "doc_id")
            order = order or [(F.col("score"), True)]
        return docs, order

    def frame(self) -> DataFrame:
        """The plan: column conditions first, then queries as semi-joins, scores where there is a query."""
        docs, order = self._matching()
        if order or self.skipped or self.limit is not None:
            docs = docs.orderBy(*[k.desc() if down else k.asc() for k, down in order], "doc_id")
        if self.skipped:
            docs = docs.offset(self.skipped)
        if self.limit is not None:
            docs = docs.limit(self.limit)
        return docs.select(*self.columns) if self.columns else docs

    def to_list(self) -> list[Row]:
        return self.frame().collect()

    def count(self) -> int:
        return self.frame().count()

    def any(self) -> bool:
        return bool(self.take(1).frame().count())

    def first(self, default: Any = ...) -> Any:
        rows = self.take(1).to_list()
        if rows:
            return rows[0]
        if default is ...:
            raise LookupError("no document matches")
        return default

    def single(self, default: Any = ...) -> Any:
        rows = self.take(2).to_list()
        if len(rows) > 1:
            raise LookupError("more than one document matches")
        return rows[0] if rows else self.first(default)

    def last(self, default: Any = ...) -> Any:
        """The first row of the reversed order; no more than one row leaves the executors, or the page that ``take`` asks for."""
        if self.limit is not None:
            rows = self.to_list()
        else:
            docs, order = self._matching()
            rows = docs.orderBy(*[k.asc() if down else k.desc() for k, down in order], F.col("doc_id").desc()).limit(1)
            rows = (rows.select(*self.columns) if self.columns else rows).collect() if not self.skipped or self.count() else []
        return rows[-1] if rows else self.first(default)

    def element_at(self, i: int) -> Row:
        return dataclasses.replace(self, skipped=self.skipped + i, limit=1).first()
