"""What is done with hits: order, pages, facets, statistics, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage

_ZERO = {"string": "", "bigint": 0, "int": 0, "double": 0.0, "float": 0.0, "smallint": 0}


def top(hits: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """A page of the best hits."""
    return hits.orderBy(F.col("score").desc(), "doc_id").offset(skip).limit(n)


def top_per_part(hits: DataFrame, n: int) -> DataFrame:
    """The best n of every partition, in no global order (for streaming results out)."""
    return hits.withColumn("_p", F.spark_partition_id()).withColumn(
        "_r", F.row_number().over(Window.partitionBy("_p").orderBy(F.col("score").desc(), "doc_id"))
    ).where(F.col("_r") <= n).drop("_p", "_r")


def fetch(hits: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with columns of their documents."""
    return hits.join(docs.select("doc_id", *columns), "doc_id", "left")


def sort_by(hits: DataFrame, docs: DataFrame, keys: list[tuple[str, bool]], n: int, skip: int = 0) -> DataFrame:
    """Order hits by columns, ``(name, descending)``; ``score`` and ``doc_id`` are names too.

    Missing values count as 0 or as an empty string; of an array its least value counts.
    """
    names = [k for k, _ in keys if k not in ("score", "doc_id")]
    rows = fetch(hits, docs, names)
    order: list[Column] = []
    for name, descending in keys:
        c = F.col(name)
        kind = rows.schema[name].dataType
        if kind.typeName() == "array":
            c, kind = F.array_min(c), kind.elementType
        zero = _ZERO.get(kind.simpleString())
        c = F.coalesce(c, F.lit(zero)) if zero is not None else c
        order.append(c.desc() if descending else c.asc())
    return rows.orderBy(*order, "doc_id").offset(skip).limit(n)


def facets(hits: DataFrame, docs: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """``(value, count)`` over all hits; a document counts once for each of its values, empty ones not at all."""
    many = docs.schema[column].dataType.typeName() == "array"
    own = fetch(hits.select("doc_id", "score"), docs, [column])
    values = F.explode(F.array_distinct(column)) if many else F.col(column)
    rows = own.select(values.cast("string").alias("value")).where("value is not null and value <> ''")
    out = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return out if n is None else out.orderBy(F.col("count").desc(), "value").limit(n)


def _values(hits: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    many = docs.schema[column].dataType.typeName() == "array"
    own = fetch(hits.select("doc_id", "score"), docs, [column])
    return own.select((F.explode(column) if many else F.col(column)).cast("double").alias("v")).where("v is not null")


def stats(hits: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """Count, least, greatest, sum and mean over all hits; each value of an array counts; zeros where none is."""
    some = lambda c: F.coalesce(c, F.lit(0.0))
    return _values(hits, docs, column).agg(
        F.count("v").alias("count"), some(F.min("v")).alias("min"), some(F.max("v")).alias("max"),
        some(F.sum("v")).alias("sum"), some(F.avg("v")).alias("avg"),
    )


def histogram(hits: DataFrame, docs: DataFrame, column: str, interval: float = 10.0) -> DataFrame:
    """``(bucket, count)`` by the bucket's lower end, empty buckets between the ends too.

    Each bucket that holds something spells out the empty ones up to the next,
    so no row carries all of them.
    """
    width = interval if interval > 0 else 10.0
    index = F.floor(F.col("v") / width)
    rows = _values(hits, docs, column).groupBy(index.alias("i")).agg(F.count(F.lit(1)).alias("count"))
    after = F.coalesce(F.lead("i").over(Window.orderBy("i")), F.col("i") + 1)
    # only buckets in use are ordered; what lies between two of them is a range
    filled = rows.withColumn("_to", after).select("i", "count", F.explode(F.sequence(F.col("i"), F.col("_to") - 1)).alias("at"))
    return filled.select((F.col("at") * width).alias("bucket"), F.when(F.col("at") == F.col("i"), F.col("count")).otherwise(0).alias("count"))


def first_by(docs: DataFrame, key: str, n: int, hits: DataFrame | None = None, descending: bool = False) -> DataFrame:
    """The first n documents (of the hits) by a column, missing values last, ties by id.

    For a collection that is sorted by the column (``maintain.sorted_by``): the
    n-th value is looked for in the column alone, then only rows up to it are
    read, so Parquet skips every part that begins behind it.
    """
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    own = docs if hits is None else docs.join(hits.select("doc_id"), "doc_id", "left_semi")
    best = own.where(F.col(key).isNotNull()).select(key).orderBy(order).limit(n)
    edge = best.agg((F.min if descending else F.max)(key).alias("e"), F.count(F.lit(1)).alias("c")).first()
    if edge["c"] == n:
        docs = docs.where(F.col(key) >= F.lit(edge["e"]) if descending else F.col(key) <= F.lit(edge["e"]))
        own = docs if hits is None else docs.join(hits.select("doc_id"), "doc_id", "left_semi")
    return own.orderBy(order, "doc_id").limit(n)


def together(hits: DataFrame, docs: DataFrame, n: int, facet: str | None = None, number: str | None = None) -> DataFrame:
    """Best hits, facet counts and statistics of one search: ``(kind, name, doc_id, value)``.

    ``kind`` is ``hit``, ``facet``, or ``count``, ``min``, ``max``, ``sum`` of
    the numbers.  The search runs once, its hits are a stage table that all
    parts read.
    """
    columns = [c for c in (facet, number) if c]
    own = hits.select("doc_id", F.col("score").cast("double").alias("score"))
    found = stage(fetch(own, docs, columns) if columns else own, "hits")
    none = F.lit(None)

    def part(rows: DataFrame, kind, name, doc, value) -> DataFrame:
        return rows.select(kind.alias("kind"), name.cast("string").alias("name"), doc.cast("long").alias("doc_id"), value.cast("double").alias("value"))

    out = part(top(found.select("doc_id", "score"), n), F.lit("hit"), none, F.col("doc_id"), F.col("score"))
    if facet:
        out = out.unionByName(part(facets(found, docs, facet), F.lit("facet"), F.col("value"), none, F.col("count")))
    if number:
        kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("v")) for k in ("count", "min", "max", "sum")])
        told = stats(found, docs, number).select(F.inline(kinds))
        out = out.unionByName(part(told, F.col("k"), none, none, F.col("v")))
    return out


def collapse(hits: DataFrame, docs: DataFrame, column: str, n: int, lowest: bool = False) -> DataFrame:
    """The best (or worst) hit of each value of a column; null values are one group.

    Result: ``group, doc_id, score, size``, best first.  The best of a group is
    found by an aggregation with partial results, so a value that a third of
    all hits share is no burden.
    """
    rows = fetch(hits.select("doc_id", "score"), docs, [column])
    group = F.coalesce(F.col(column).cast("string"), F.lit("__null__"))
    key = F.struct((F.col("score") if lowest else -F.col("score")).alias("k"), F.col("doc_id").alias("doc_id"))
    best = rows.groupBy(group.alias("group")).agg(F.min(key).alias("_b"), F.count(F.lit(1)).alias("size"))
    score = F.col("_b.k") if lowest else -F.col("_b.k")
    return best.select("group", F.col("_b.doc_id").alias("doc_id"), score.alias("score"), "size").orderBy(F.col("score").desc(), "doc_id").limit(n)
