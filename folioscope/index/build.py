"""The index: a few tables derived from a collection.

``postings``      field, term, doc_id, tf, dl, boost, positions; starts and ends where a field keeps offsets
``term_stats``    field, term, df, cf
``corpus_stats``  field, n_docs, sum_dl, avgdl (one row per field)
``docs``          the collection, one row per document

A document's postings are made where its text is read, without a shuffle: its
terms are counted inside the task, and every part of the table is sorted by
field and term, so a search skips what it does not ask for.  The length of a
document's field stands in each of its postings, so scoring joins nothing but
statistics.  A stored index has its postings in ranges of field, term and
document, which cut the list of a common term into as many parts as it needs.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..analysis import streams
from ..runtime import ship_package, spread, stage
from .schema import FieldSpec

_POSTINGS = (
    "field string, term string, doc_id bigint, tf int, dl int, boost double, positions array<int>, starts array<int>, ends array<int>"
)
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.list_(pa.int32())] * 3]
_COUNTS = "field string, term string, doc_id bigint, tf int, dl int, boost double"


@dataclass(frozen=True)
class _Column:
    """How the values of a column become tokens: by ``local`` terms, by a ``stream``, or as they are."""

    name: str
    boost: float
    local: Callable[[str], list[str]] | None = None
    stream: streams.Source | None = None
    offsets: bool = False
    exact: bool = False

    def tokens(self, value) -> tuple[list[str], list[int] | range, list[int], list[int]]:
        """Terms, positions, and offsets where they are kept."""
        values = [v for v in (value if isinstance(value, list) else [value]) if v is not None]
        if self.exact:
            terms = list(dict.fromkeys(values))
            return terms, range(len(terms)), [], []
        if self.stream is None:
            terms = [t for v in values for t in self.local(v)] if self.local else values
            return terms, range(len(terms)), [], []
        own = [t for v in values for t in self.stream(v)]
        # offsets are those of a single text
        starts, ends = ([t[2] for t in own], [t[3] for t in own]) if self.offsets and len(values) < 2 else ([], [])
        return [t[0] for t in own], streams.positions(own), starts, ends


def _lists(values: list[list[int]]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.fromiter(itertools.chain.from_iterable(values), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _invert(columns: list[_Column]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``doc_id, boost`` and one column for each field to postings, document by document."""

    def field(c: _Column, docs: list, boosts: list, values: list) -> list[pa.Array]:
        terms: list[str] = []
        places: list[list[int]] = []
        starts: list[list[int] | None] = []
        ends: list[list[int] | None] = []
        owner, each, sizes, weights = [], [], [], []
        for doc, boost, value in zip(docs, boosts, values):
            if value is None:
                continue
            own, at, first, last = c.tokens(value)
            if not own:
                continue
            held: dict[str, list[int]] = defaultdict(list)
            for i, t in enumerate(own):
                held[t].append(i)
            terms.extend(held)
            if isinstance(at, range):
                places.extend(held.values())
            else:
                places.extend([at[i] for i in v] for v in held.values())
            if c.offsets:
                starts.extend([first[i] for i in v] if first else None for v in held.values())
                ends.extend([last[i] for i in v] if last else None for v in held.values())
            owner.append(doc)
            each.append(len(held))
            sizes.append(len(own))
            weights.append(boost * c.boost)
        n = len(terms)
        spread_ = lambda x, kind: pa.array(np.repeat(np.array(x, kind), each))
        offsets = [pa.array(x, _KINDS[-1]) for x in (starts, ends)] if c.offsets else [pa.nulls(n, _KINDS[-1])] * 2
        return [
            pa.array([c.name] * n, pa.string()), pa.array(terms, pa.string()), spread_(owner, np.int64),
            pa.array([len(p) for p in places], pa.int32()), spread_(sizes, np.int32), spread_(weights, np.float64), _lists(places), *offsets,
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _POSTINGS.split(", ")]
        for batch in batches:
            docs, boosts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, c in enumerate(columns):
                yield pa.RecordBatch.from_arrays(field(c, docs, boosts, batch.column(i + 2).to_pylist()), names)

    return run


def _count(columns: list[_Column]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As ``_invert``, without positions; each document has a row without a term as well, its length as ``tf``."""

    def field(c: _Column, docs: list, boosts: list, values: list) -> list[pa.Array]:
        terms: list[str | None] = []
        counts: list[int] = []
        owner, each, sizes, weights = [], [], [], []
        for doc, boost, value in zip(docs, boosts, values):
            own = c.tokens(value)[0] if value is not None else []
            if not own:
                continue
            held = Counter(own)
            terms.append(None)
            terms.extend(held)
            counts.append(len(own))
            counts.extend(held.values())
            owner.append(doc)
            each.append(len(held) + 1)
            sizes.append(len(own))
            weights.append(boost * c.boost)
        spread_ = lambda x, kind: pa.array(np.repeat(np.array(x, kind), each))
        return [
            pa.array([c.name] * len(terms), pa.string()), pa.array(terms, pa.string()), spread_(owner, np.int64),
            pa.array(counts, pa.int32()), spread_(sizes, np.int32), spread_(weights, np.float64),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _COUNTS.split(", ")]
        for batch in batches:
            docs, boosts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, c in enumerate(columns):
                yield pa.RecordBatch.from_arrays(field(c, docs, boosts, batch.column(i + 2).to_pylist()), names)

    return run


@dataclass
class Index:
    """The tables of an index, and how its text fields are analysed."""

    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    fields: dict[str, FieldSpec]

    @functools.cached_property
    def corpus(self) -> dict[str, tuple[int, int, float]]:
        """``field -> (n_docs, sum_dl, avgdl)``, read once; one entry per field."""
        return {r["field"]: (r["n_docs"], r["sum_dl"], r["avgdl"]) for r in self.corpus_stats.collect()}

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def staged(self) -> Index:
        """The same, with its derived tables written out once; postings do not move."""
        postings = stage(self.postings.sortWithinPartitions(*ORDER), "postings")
        stats = stage(term_stats_of(postings), "term-stats")
        # one row for each field
        sums = {r["field"]: r["s"] for r in stats.groupBy("field").agg(F.sum("cf").alias("s")).collect()}
        n = live(self.docs).count()
        rows = [(f, n, sums.get(f, 0), sums[f] / n if sums.get(f) and n else 1.0) for f in indexed(self.fields)]
        corpus = self.spark.createDataFrame(rows, "field string, n_docs bigint, sum_dl bigint, avgdl double")
        made = Index(self.docs, postings, stats, corpus, self.fields)
        made.corpus = {f: (n, s, a) for f, n, s, a in rows}
        return made

    def cached(self) -> Index:
        """The same, kept in the executors' memory (or on their disks) once read."""
        for df in (self.docs, self.postings, self.term_stats, self.corpus_stats):
            df.persist()
        return self


#: How postings are ordered within a part.
ORDER = ("field", "term", "doc_id")


def indexed(fields: dict[str, FieldSpec]) -> list[str]:
    """The fields that have postings."""
    return [n for n, f in fields.items() if f.kind in ("text", "string")]


def live(docs: DataFrame) -> DataFrame:
    """Documents that are not marked as deleted."""
    return docs.where("deleted_at is null") if "deleted_at" in docs.columns else docs


def term_stats_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


def corpus_stats_of(docs: DataFrame, stats: DataFrame, fields: list[str]) -> DataFrame:
    """From term statistics; the average length is over all documents, those without the field too; 1 where none has it."""
    spark = docs.sparkSession
    named = spark.createDataFrame([(f,) for f in fields], "field string")
    sums = stats.groupBy("field").agg(F.sum("cf").cast("long").alias("sum_dl"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    avg = F.when(F.coalesce("sum_dl", F.lit(0)) > 0, F.col("sum_dl") / F.col("n_docs")).otherwise(1.0)
    return named.join(F.broadcast(sums), "field", "left").crossJoin(F.broadcast(n)).select(
        "field", "n_docs", F.coalesce("sum_dl", F.lit(0)).alias("sum_dl"), avg.alias("avgdl")
    )


def postings_of(docs: DataFrame, fields: list[FieldSpec], key: str = "doc_id", counts: bool = False) -> DataFrame:
    """Postings of the text and string fields of a collection.

    Texts are analysed by the analyser's stream or local form in the task that
    reads them; an analyser that has neither is run by Spark first.  With
    ``counts`` they have no positions, and lengths as rows without a term.
    """
    ship_package(docs.sparkSession)
    plans, values = [], []
    for f in fields:
        value = F.col(f.name)
        many = docs.schema[f.name].dataType.typeName() == "array"
        if f.kind == "string":
            plans.append(_Column(f.name, f.boost, exact=True))
        elif f.offsets and f.analyser.stream is None:
            raise ValueError(f"the analyser of {f.name} knows no offsets")
        elif f.offsets or f.analyser.local is None:
            stream = f.analyser.stream
            plans.append(_Column(f.name, f.boost, stream=stream, offsets=f.offsets))
            run = f.analyser.prepared if stream else f.analyser.terms
            value = (F.transform(value, run) if stream else F.flatten(F.transform(value, run))) if many else run(value)
        else:
            plans.append(_Column(f.name, f.boost, local=f.analyser.local))
            value = F.transform(value, f.analyser.prepared) if many else f.analyser.prepared(value)
        values.append(value.alias(f"_{len(values)}"))
    boost = F.coalesce(F.col("boost").cast("double"), F.lit(1.0)) if "boost" in docs.columns else F.lit(1.0)
    own = spread(docs).where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), boost.alias("_boost"), *values)
    return own.mapInArrow(_count(plans), _COUNTS) if counts else own.mapInArrow(_invert(plans), _POSTINGS)


def build(docs: DataFrame, fields: list[FieldSpec], key: str = "doc_id") -> Index:
    """Index a collection.  Documents without a key are left out."""
    own = docs.where(F.col(key).isNotNull())
    if key != "doc_id":
        own = own.withColumn("doc_id", F.col(key).cast("long"))
    named = {f.name: f for f in fields}
    postings = postings_of(docs, [named[n] for n in indexed(named)], key)
    stats = term_stats_of(postings)
    return Index(own, postings, stats, corpus_stats_of(own, stats, indexed(named)), named)


def narrowed(docs: DataFrame, spec: FieldSpec, terms: DataFrame) -> Index:
    """An index of some terms of a field (``term``) alone, with the statistics of all documents.

    For searches whose terms are known beforehand and that need no positions:
    texts are analysed once, and only postings of these terms are written out.
    """
    listed = stage(terms.where("term is not null").select("term", F.lit(True).alias("_listed")).distinct(), "terms")
    rows = postings_of(docs, [spec], counts=True).join(listed, "term", "left").where("term is null or _listed")
    own = stage(rows.select(*[x.split()[0] for x in _COUNTS.split(", ")]), "counts")
    postings, kept = own.where("term is not null"), docs.where("doc_id is not null")
    stats = stage(term_stats_of(postings), "term-stats")
    n, s = live(kept).count(), own.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("s")).first()["s"]
    corpus = [(spec.name, n, s, s / n if s and n else 1.0)]
    made = Index(kept, postings, stats, docs.sparkSession.createDataFrame(corpus, "field string, n_docs bigint, sum_dl bigint, avgdl double"), {spec.name: spec})
    made.corpus = {f: (n, s, a) for f, n, s, a in corpus}
    return made


def write(index: Index, path: str, codec: str = "zstd") -> None:
    """Persist an index: postings by field, in ranges of term and document, sorted.

    The postings are staged first, so that finding the ranges does not analyse
    the texts a second time.
    """
    spark = index.spark
    staged = stage(index.postings, "postings")
    (
        staged.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
        .write.mode("overwrite").option("compression", codec).partitionBy("field").parquet(f"{path}/postings")
    )
    term_stats_of(spark.read.schema(_POSTINGS).parquet(f"{path}/postings")).write.mode("overwrite").option("compression", codec).parquet(f"{path}/term_stats")
    stats = spark.read.schema("field string, term string, df bigint, cf bigint").parquet(f"{path}/term_stats")
    corpus_stats_of(live(index.docs), stats, indexed(index.fields)).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    index.docs.write.mode("overwrite").option("compression", codec).parquet(f"{path}/docs")


def open_index(spark: SparkSession, path: str, fields: list[FieldSpec]) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("docs"), spark.read.schema(_POSTINGS).parquet(f"{path}/postings"), read("term_stats"), read("corpus_stats"), {f.name: f for f in fields})
