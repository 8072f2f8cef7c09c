"""Nearest vectors: exact, quantised, and by an inverted file of clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..runtime import ship_package, stage

#: Vectors that the cluster centres are fitted on, at most.
SAMPLE = 20_000


def exact(vectors: DataFrame, column: str, query: list[float], k: int) -> DataFrame:
    """``(doc_id, score)``: the k nearest by cosine, then by id."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(column).isNotNull()).select("doc_id", v.cosine(F.col(column), target).alias("score"))
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(k)


def ranges(vectors: DataFrame, column: str) -> DataFrame:
    """One row ``(low, step)`` for 8-bit vectors."""
    ends = vectors.select(F.array_min(column).alias("lo"), F.array_max(column).alias("hi")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ends.select(F.col("lo").cast("double").alias("low"), F.greatest((F.col("hi") - F.col("lo")).cast("double") / 255, F.lit(1e-12)).alias("step"))


def centre(vectors: DataFrame, column: str) -> DataFrame:
    """One row ``(centre)``: the mean of every component."""
    parts = vectors.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


@dataclass
class Coded:
    """Vectors with their 8-bit codes, made once; a search reads the codes, and whole vectors of a shortlist only."""

    rows: DataFrame
    column: str
    low: float
    step: float

    def search(self, query: list[float], k: int, oversample: int = 4) -> DataFrame:
        """Shortlist by the codes, ranked again by the exact cosine."""
        target = F.array(*[F.lit(float(x)) for x in query])
        back = v.from_int8(F.col("code"), F.lit(self.low), F.lit(self.step))
        rough = self.rows.select("doc_id", v.cosine(back, target).alias("_s")).orderBy(F.col("_s").desc(), "doc_id").limit(k * oversample)
        return exact(self.rows.join(F.broadcast(rough.select("doc_id")), "doc_id", "left_semi"), self.column, query, k)


def coded(vectors: DataFrame, column: str) -> Coded:
    """Code every vector, as a stage table; null vectors are left out."""
    own = vectors.where(F.col(column).isNotNull()).select("doc_id", column)
    ends = ranges(own, column).first()
    low, step = (ends["low"], ends["step"]) if ends["low"] is not None else (0.0, 1.0)
    return Coded(stage(own.withColumn("code", v.int8(F.col(column), F.lit(low), F.lit(step))), "codes"), column, low, step)


def int8(vectors: DataFrame, column: str, query: list[float], k: int, oversample: int = 4) -> DataFrame:
    """A single search by 8-bit codes; for several keep what :func:`coded` returns."""
    return coded(vectors, column).search(query, k, oversample)


#: Vectors and queries that meet in one task of :func:`signs`, about.
SIGN_DOCS, SIGN_QUERIES = 20_000, 2_000


def signs(vectors: DataFrame, column: str, queries: DataFrame, k: int, oversample: int = 8) -> DataFrame:
    """``(query_id, doc_id, score)``: the k nearest of each ``(query_id, vector)``, found by sign bits.

    The ``k * oversample`` nearest by the Hamming distance of the signs around
    the mean give a score that the k-th best has at least.  The signs also say
    how large a cosine can be (a component on the other side of the mean adds
    nothing), and every vector that could reach that score is scored exactly,
    so the result is exact whatever the data; only the work depends on it.
    Vectors and queries meet in blocks; only k of a block go on.
    """
    ship_package(vectors.sparkSession)
    own = vectors.where(F.col(column).isNotNull()).select("doc_id", F.col(column).cast("array<double>").alias("v"))
    asked = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    mean = np.array(centre(own, "v").first()["centre"] or [], float)
    rows, i = -(-own.count() // SIGN_DOCS) or 1, -(-asked.count() // SIGN_QUERIES) or 1
    docs = own.withColumn("d", F.pmod(F.xxhash64("doc_id"), F.lit(rows)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(i - 1))))
    wanted = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(i)).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    met = docs.groupBy("d", "q").cogroup(wanted.groupBy("d", "q")).applyInPandas(
        lambda x, p: _by_signs(x, p, mean, k, k * oversample), "query_id bigint, doc_id bigint, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def _by_signs(docs: pd.DataFrame, asked: pd.DataFrame, mean: np.ndarray, k: int, short: int) -> pd.DataFrame:
    """The k nearest of one block; vectors of another length than the mean's score 0, as do zero vectors."""
    out = []
    if len(docs) and len(asked):
        fit = lambda col: np.stack([x if len(x) == len(mean) else np.zeros(len(mean)) for x in col])
        docs = docs.sort_values("doc_id", kind="stable")
        ids, x = docs["doc_id"].to_numpy(), fit(docs["v"])
        unit, above = _unit(x), x > mean
        bits = np.packbits(above, axis=1)
        size = np.linalg.norm(x, axis=1)
        spread = np.divide(np.linalg.norm(x - mean, axis=1), size, out=np.zeros(len(x)), where=size > 0)
        inverse = np.divide(1.0, size, out=np.zeros(len(x)), where=size > 0)
        raw = fit(asked["vector"])
        for qid, q, u in zip(asked["query_id"], raw, _unit(raw)):
            far = np.bitwise_count(bits ^ np.packbits(q > mean)).sum(axis=1)
            first = np.argpartition(far, short)[:short] if len(far) > short else np.arange(len(far))
            scores = unit[first] @ u
            least = np.sort(scores)[-k] if len(scores) >= k else -np.inf
            # q.x = q.mean + q.(x - mean), and only components where q and x - mean agree in sign add to the latter
            square = u * u
            agree = np.where(above, square * (u > 0), square * (u < 0)).sum(axis=1)
            most = (u @ mean) * inverse + np.sqrt(agree) * spread
            # a component equal to the mean counts as below it, and adds nothing
            could = np.flatnonzero((most >= least - 1e-9) | (size == 0))
            scores = unit[could] @ u
            top = np.lexsort((ids[could], -scores))[:k]
            out.append(pd.DataFrame({"query_id": qid, "doc_id": ids[could][top], "score": scores[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})


@dataclass
class Clusters:
    """Vectors by their nearest centre; clusters of more than ``GROUP`` vectors are in several parts."""

    assigned: DataFrame
    column: str
    centres: np.ndarray
    parts: list[int]

    def near(self, query: list[float], probes: int) -> list[int]:
        """The clusters nearest to a vector."""
        return np.argsort(-(self.centres @ _unit(np.array([query], float))[0]), kind="stable")[:probes].tolist()

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """``(query_id, doc_id, score)``: k neighbours of each ``(query_id, vector)``.

        A query meets the vectors of its ``probes`` nearest clusters.  Pairs are
        scored in blocks inside a task; only k of a block go on.
        """
        probed = queries.where("vector is not null").mapInArrow(_probes(self.centres, self.parts, probes), "query_id bigint, vector array<double>, cluster int, salt int")
        docs = self.assigned.select("cluster", "salt", F.col("doc_id"), F.col(self.column).cast("array<double>").alias("v"))
        met = docs.groupBy("cluster", "salt").cogroup(probed.groupBy("cluster", "salt")).applyInPandas(
            lambda d, p: _nearest(d, p, k), "query_id bigint, doc_id bigint, score double"
        )
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
        return met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


#: Vectors of a cluster that one task takes, about; larger clusters are cut by the hash of the id.
GROUP = 20_000
#: Clusters at most, where their number follows the number of vectors.
MOST_CLUSTERS = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _probes(centres: np.ndarray, parts: list[int], probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            near = np.argsort(-(_unit(np.array(vectors, float)) @ centres.T), axis=1)[:, :probes]
            rows = [(i, x, int(c), s) for i, x, cs in zip(ids, vectors, near) for c in cs for s in range(parts[c])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32()))],
                ["query_id", "vector", "cluster", "salt"],
            )

    return run


def _nearest(docs: pd.DataFrame, probes: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(docs) and len(probes):
        x = _unit(np.stack(docs["v"].to_numpy()))
        ids = docs["doc_id"].to_numpy()
        for at in range(0, len(probes), 256):
            p = probes.iloc[at : at + 256]
            s = _unit(np.stack(p["vector"].to_numpy())) @ x.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            for qid, row, order in zip(p["query_id"], s, top):
                out.append(pd.DataFrame({"query_id": qid, "doc_id": ids[order], "score": row[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})


def cluster(vectors: DataFrame, column: str, clusters: int | None = None, rounds: int = 15, sample: int = SAMPLE) -> Clusters:
    """Fit centres on a bounded sample (those with the smallest hash), then index every vector.

    Without a number of clusters their number is the root of that of the
    vectors, between 16 and ``MOST_CLUSTERS``.
    """
    ship_package(vectors.sparkSession)
    own = vectors.where(F.col(column).isNotNull()).select("doc_id", column)
    if clusters is None:
        clusters = int(min(MOST_CLUSTERS, max(16, own.count() ** 0.5)))
    # only ids and hashes are ranked; the vectors of the chosen follow
    ids = own.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample).select("doc_id")
    picked = own.join(F.broadcast(ids), "doc_id", "left_semi").toPandas().sort_values("doc_id")
    x = _unit(np.stack(picked[column].to_numpy()).astype(float)) if len(picked) else np.zeros((1, 1))
    centres = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        centres = _unit(np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))]))

    def nearest(batch):
        return pd.Series((_unit(np.stack(batch.to_numpy()).astype(float)) @ centres.T).argmax(1).astype("int32"))

    assigned = stage(own.withColumn("cluster", F.pandas_udf(nearest, "int")(F.col(column).cast("array<double>"))), "clusters")
    sizes = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cluster
    parts = [max(1, -(-sizes.get(c, 0) // GROUP)) for c in range(len(centres))]
    by = F.element_at(F.array(*[F.lit(n) for n in parts]), F.col("cluster") + 1)
    return Clusters(assigned.withColumn("salt", F.pmod(F.xxhash64("doc_id"), by).cast("int")), column, centres, parts)
