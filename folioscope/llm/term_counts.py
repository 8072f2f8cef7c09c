"""Frequency of every distinct term, and in how many records it occurs.

Method: term counts are emitted record by record, combined in a hash table per
task before anything is shuffled, then summed by term; frequency bounds mark
terms too rare or too common to be useful.

What is shuffled is one row per term and task, never one per occurrence, so a
term that a third of all records hold costs no more than any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import one_row_per_id, ship_package, spread, stage
from .text import terms

#: Distinct terms a task holds before it hands its partial sums on.
FLUSH_TERMS = 400_000

_PARTIAL = "term string, occurrences bigint, records bigint"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(seen)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.string()),
                pa.array([seen[k] for k in keys], pa.int64()),
                pa.array([held[k] for k in keys], pa.int64()),
            ],
            ["term", "occurrences", "records"],
        )
        seen.clear()
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            own = Counter(terms(text))
            seen.update(own)
            held.update(own.keys())
        if len(seen) > FLUSH_TERMS:
            yield flush()
    if seen:
        yield flush()


def text_term_counts(records: DataFrame, text: str) -> DataFrame:
    """``(term, occurrences, records)`` over texts, one row per record given.

    Null and empty texts hold no term.  Other columns are ignored, whatever
    their names; the order of the result is not defined.
    """
    ship_package(records.sparkSession)
    partial = spread(records).select(F.col(text).alias("text")).where("text is not null").mapInArrow(_combine, _PARTIAL)
    return partial.groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )


def posting_term_counts(
    postings: DataFrame, term: str = "term", doc: str = "doc_id", frequency: str = "frequency"
) -> tuple[DataFrame, DataFrame]:
    """The same from postings: each posting once, as a stage table, and the counts.

    A posting counts when its frequency is above 0 and neither term nor record
    is null.  A term posted twice for one record (a segment flushed again)
    counts once, with the larger frequency.  Repeats are combined before the
    shuffle, and the one shuffle is by record and term, so neither a common
    term nor a large segment makes a large group.
    """
    live = postings.select(
        F.col(doc).alias("doc_id"), F.col(term).alias("term"), F.col(frequency).cast("long").alias("tf")
    ).where("tf > 0 and term is not null and doc_id is not null")
    once = stage(live.groupBy("doc_id", "term").agg(F.max("tf").alias("tf")), "once")
    return once, once.groupBy("term").agg(
        F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("records")
    )


def mark_terms(
    counts: DataFrame, records: DataFrame, rare_records: int = 2, common_share: float = 0.2
) -> DataFrame:
    """Add ``mark``: ``rare``, ``common`` or null.

    ``records`` is one row with ``n``, the number of records.  A term in at
    most ``rare_records`` records is rare; one in more than ``common_share`` of
    them is common.  A term that is both (a tiny collection) is rare.
    """
    return counts.crossJoin(F.broadcast(records.select(F.col("n").alias("_n")).limit(1))).select(
        *counts.columns,
        F.when(F.col("records") <= rare_records, "rare")
        .when(F.col("records") > F.col("_n") * common_share, "common")
        .alias("mark"),
    )


def count_records(records: DataFrame) -> DataFrame:
    """One row with the number of records, as ``mark_terms`` takes it."""
    return records.agg(F.count(F.lit(1)).alias("n"))


def text_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, text)``, one row per id, null texts left out."""
    return one_row_per_id(
        spread(df).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null"), "doc_id"
    )
