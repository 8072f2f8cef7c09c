"""How characteristic each term is of each record.

Method: the log-odds ratio of a term in the record against the rest of the
collection, with an informative Dirichlet prior taken from the collection's own
counts, divided by its standard error (a z-score).

For a term that occurs y times in a record of n terms, Y times in a collection
of N terms, and a prior of weight ``prior`` spread as the collection is,
a = prior * Y / N::

    delta = ln((y + a) / (n + prior - y - a))
          - ln((Y - y + a) / (N - n + prior - Y + y - a))
    z = delta / sqrt(1 / (y + a) + 1 / (Y - y + a))
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship_package, stage
from .term_counts import posting_term_counts, text_term_counts
from .text import terms

#: Weight of the prior, in terms.
PRIOR = 500.0
#: Terms whose statistics may be broadcast; see :func:`score`.
HEAVY_TERMS = 20_000

_PAIRS = "doc_id bigint, term string, tf bigint, record_terms bigint"


def log_odds_z(tf: Column, n: Column, cf: Column, total: Column, prior: float = PRIOR) -> Column:
    """The z-score as a column; null where the rest of the collection is empty."""
    a = cf * (F.lit(prior) / total)
    rest = cf - tf + a
    own = F.log((tf + a) / (n + prior - tf - a))
    other = F.log(rest / (total - n + prior - rest))
    return (own - other) / F.sqrt(1 / (tf + a) + 1 / rest)


def _emit(min_count: int, min_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            counts: list[int] = []
            ids, sizes, each = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                words = terms(text)
                own = Counter(words)
                if min_count > 1 or min_length > 1:
                    own = {t: c for t, c in own.items() if c >= min_count and len(t) >= min_length}
                found.extend(own)
                counts.extend(own.values())
                ids.append(doc)
                sizes.append(len(words))
                each.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(ids, np.int64), each)), pa.array(found, pa.string()), pa.array(counts, pa.int64()),
                    pa.array(np.repeat(np.array(sizes, np.int64), each)),
                ],
                ["doc_id", "term", "tf", "record_terms"],
            )

    return pairs


def record_terms(records: DataFrame, min_count: int = 1, min_length: int = 1) -> DataFrame:
    """``(doc_id, term, tf, record_terms)`` of ``(doc_id, text)``, without a shuffle."""
    ship_package(records.sparkSession)
    return records.select("doc_id", "text").where("text is not null").mapInArrow(_emit(min_count, min_length), _PAIRS)


def score(
    pairs: DataFrame,
    stats: DataFrame,
    prior: float = PRIOR,
    min_records: int = 1,
    max_records: int | None = None,
) -> DataFrame:
    """Score pairs against term statistics ``(term, occurrences, records)``.

    ``stats`` should be a stage table.  Let P be the sum of ``records``.  Terms
    held by more than P / HEAVY_TERMS records number fewer than HEAVY_TERMS, so
    their statistics are broadcast whatever the collection's size; the others
    are joined by a shuffle in which no key exceeds that many rows.  Bounds on
    the number of records are applied to the statistics, before the join.

    Result: ``doc_id, term, tf, record_terms, occurrences, records, z``.
    """
    total = stats.agg(F.sum("occurrences").alias("total"), F.sum("records").alias("held")).first()
    if not total["held"]:
        return (
            pairs.withColumn("occurrences", F.lit(0).cast("long"))
            .withColumn("records", F.lit(0).cast("long"))
            .withColumn("z", F.lit(None).cast("double"))
            .where("false")
        )
    bound = max(1, total["held"] // HEAVY_TERMS)
    wanted = F.col("records") >= min_records
    if max_records is not None:
        wanted &= F.col("records") <= max_records
    heavy = stats.where(F.col("records") > bound).select(
        F.col("term").alias("_h"), F.col("occurrences").alias("_hc"), F.col("records").alias("_hr")
    )
    light = stats.where((F.col("records") <= bound) & wanted).select(
        F.col("term").alias("_l"), F.col("occurrences").alias("_lc"), F.col("records").alias("_lr")
    )
    at = pairs.join(F.broadcast(heavy), F.col("term") == F.col("_h"), "left")
    rare = at.where("_h is null").join(light, F.col("term") == F.col("_l")).select(
        "doc_id", "term", "tf", "record_terms", F.col("_lc").alias("occurrences"), F.col("_lr").alias("records")
    )
    out = rare
    if max_records is None or max_records > bound:
        # heavy terms have their statistics already and do not move
        known = at.where(F.col("_h").isNotNull()).select(
            "doc_id", "term", "tf", "record_terms", F.col("_hc").alias("occurrences"), F.col("_hr").alias("records")
        )
        out = rare.unionByName(known.where(wanted))
    return out.withColumn(
        "z",
        log_odds_z(F.col("tf"), F.col("record_terms"), F.col("occurrences"), F.lit(float(total["total"])), prior),
    )


def distinctive_terms(
    records: DataFrame,
    prior: float = PRIOR,
    min_count: int = 1,
    min_length: int = 1,
    min_records: int = 1,
    max_records: int | None = None,
) -> DataFrame:
    """Score the terms of ``(doc_id, text)``, one row per record.

    Null and empty texts give no rows; a collection of one record has no rest
    and gets null scores.  The text is read twice (once for the collection's
    counts, once for the scores), which costs less than moving every pair.
    """
    stats = stage(text_term_counts(records, "text"), "term-stats")
    return score(record_terms(records, min_count, min_length), stats, prior, min_records, max_records)


def most_distinctive(scored: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n terms of each record with the highest z (to six places), ties by term; adds ``place`` from 1.

    Spark keeps n rows of a record in each task before it moves any.
    """
    rows = scored.withColumn("z", F.round("z", 6))
    order = Window.partitionBy(*by).orderBy(F.col("z").desc_nulls_last(), "term")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def distinctive_postings(postings: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Score postings ``(term, doc_id, frequency)`` by their frequency.

    The length of a record is the sum of its live postings.  Repeated postings
    count once (see :func:`posting_term_counts`).
    """
    once, _ = posting_term_counts(postings)
    sizes = once.groupBy("doc_id").agg(F.sum("tf").alias("record_terms"))
    pairs = stage(once.join(sizes, "doc_id").select("doc_id", "term", "tf", "record_terms"), "postings")
    stats = stage(pairs.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("records")), "term-stats")
    return score(pairs, stats, prior)
