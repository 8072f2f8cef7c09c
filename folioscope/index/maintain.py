"""Changing, keeping and checking an index.

A stored index is a folder of versions, each a complete set of tables; the
latest of a few small numbered files names the current one.
"""

from __future__ import annotations

import dataclasses
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .build import _POSTINGS, ORDER, Index, build, corpus_stats_of, indexed, live, open_index, term_stats_of, write
from ..runtime import Files
from .schema import FieldSpec


def add(index: Index, docs: DataFrame) -> Index:
    """Add documents; statistics are summed anew from postings."""
    more = build(docs, list(index.fields.values()))
    return _with(index, index.docs.unionByName(more.docs, allowMissingColumns=True), index.postings.unionByName(more.postings))


def add_blocks(index: Index, blocks: DataFrame, children: DataFrame, parent: str = "parent_id") -> Index:
    """Add parents ``blocks`` with the ``children`` that name them, as one change.

    Children of no given parent, and parents whose children cannot all be
    added, are errors of the data; they are left out together, so no block is
    ever there in part.  Both keep ``parent`` (null for parents).
    """
    known = blocks.where("doc_id is not null").select(F.col("doc_id").alias(parent)).distinct()
    broken = children.where(F.col("doc_id").isNull()).select(parent).distinct()
    whole = known.join(broken, parent, "left_anti")
    tops = blocks.join(whole.select(F.col(parent).alias("doc_id")), "doc_id", "left_semi").withColumn(parent, F.lit(None).cast("long"))
    inner = children.join(whole, parent, "left_semi")
    return add(index, tops.unionByName(inner, allowMissingColumns=True))


def merge(index: Index, other: Index) -> Index:
    """Take in another index of the same fields; of a document in both the other's is kept."""
    index = delete(index, other.docs)
    return _with(index, index.docs.unionByName(other.docs, allowMissingColumns=True), index.postings.unionByName(other.postings))


def delete(index: Index, matches: DataFrame) -> Index:
    """Delete the documents of ``(doc_id, ...)``; their postings go too."""
    gone = matches.select("doc_id").distinct()
    return _with(index, index.docs.join(gone, "doc_id", "left_anti"), index.postings.join(gone, "doc_id", "left_anti"))


def delete_by_term(index: Index, field: str, term: str) -> Index:
    return delete(index, index.postings.where((F.col("field") == field) & (F.col("term") == term)))


def update(index: Index, matches: DataFrame, docs: DataFrame) -> Index:
    """Delete what matches, then add."""
    return add(delete(index, matches), docs)


def soft_delete(index: Index, matches: DataFrame, at: Column | None = None) -> Index:
    """Mark documents as deleted; they leave the postings but stay in ``docs``."""
    gone = matches.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    had = F.col("deleted_at") if "deleted_at" in index.docs.columns else F.lit(None).cast("timestamp")
    docs = index.docs.withColumn("deleted_at", had).join(gone, "doc_id", "left")
    docs = docs.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at if at is not None else F.current_timestamp()).otherwise(F.col("deleted_at")))
    return _with(index, docs.drop("_gone"), index.postings.join(gone.select("doc_id"), "doc_id", "left_anti"))


def purge(index: Index, keep_seconds: int = 86_400, now: Column | None = None) -> Index:
    """Drop documents that were marked as deleted longer ago than ``keep_seconds``."""
    if "deleted_at" not in index.docs.columns:
        return index
    now = F.current_timestamp() if now is None else now
    old = F.col("deleted_at").isNotNull() & (F.unix_seconds("deleted_at") < F.unix_seconds(now) - keep_seconds)
    return _with(index, index.docs.where(~old), index.postings)


def _with(index: Index, docs: DataFrame, postings: DataFrame) -> Index:
    stats = term_stats_of(postings)
    return Index(docs, postings, stats, corpus_stats_of(live(docs), stats, indexed(index.fields)), index.fields)


def compact(index: Index, files: int) -> Index:
    """Fewer, larger parts of the postings, in ranges of term and document."""
    return dataclasses.replace(index, postings=index.postings.repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER))


def sorted_by(index: Index, columns: list[Column]) -> Index:
    """Documents in an order, part by part, so that filters on it skip row groups."""
    return dataclasses.replace(index, docs=index.docs.repartitionByRange(*columns).sortWithinPartitions(*columns))


def check(index: Index) -> DataFrame:
    """``(problem, rows)``: what the tables of an index contradict each other in; empty where sound."""
    found = index.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("s"))
    stats = index.term_stats.join(found, ["field", "term"], "full")
    tests = {
        "term statistics differ from postings": stats.where("not (df <=> n and cf <=> s)"),
        "posting without document": index.postings.join(index.docs.select("doc_id"), "doc_id", "left_anti"),
        "frequency differs from positions": index.postings.where("tf <> size(positions)"),
        "posting listed twice": index.postings.groupBy("field", "term", "doc_id").count().where("count > 1"),
        "document listed twice": index.docs.groupBy("doc_id").count().where("count > 1"),
    }
    out = None
    for name, rows in tests.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("problem"), "rows").where("rows > 0")
        out = one if out is None else out.unionByName(one)
    return out


class Store:
    """Versions of an index in a folder of any filesystem Spark can write to.

    A change of what is current is a new head file with the next number, which
    only one writer can create; readers take the highest.
    """

    #: Head files that are kept.
    HEADS = 20
    TABLES = ("docs", "postings", "term_stats", "corpus_stats")

    def __init__(self, spark: SparkSession, path: str, fields: list[FieldSpec]):
        self.spark, self.path, self.fields, self.files = spark, path.rstrip("/"), fields, Files(spark)

    def _heads(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names(f"{self.path}/heads") if n.endswith(".json") and n[0].isdigit())

    def _head(self) -> dict:
        known = self._heads()
        return json.loads(self.files.read(f"{self.path}/heads/{known[-1]:012d}.json")) if known else {"number": 0, "current": None, "versions": [], "pinned": []}

    def _set(self, head: dict) -> None:
        """Publish a head; fails where another writer was faster."""
        known = self._heads()
        number = head["number"] + 1
        self.files.create(f"{self.path}/heads/{number:012d}.json", json.dumps({**head, "number": number}))
        for n in known[: -self.HEADS]:
            self.files.delete(f"{self.path}/heads/{n:012d}.json")

    def prepare(self, index: Index) -> str:
        """Write a version without making it current."""
        name = f"v{time.time_ns()}"
        write(index, f"{self.path}/{name}")
        return name

    def publish(self, name: str, keep: int | None = None, keep_seconds: float | None = None) -> None:
        """Make a prepared version current.

        Of the others the latest ``keep`` stay, or those younger than
        ``keep_seconds``, or all; versions that a snapshot pins stay in any case.
        """
        head = self._head()
        versions = [*head["versions"], name]
        old: set[str] = set()
        if keep is not None:
            old |= set(versions[:-keep] if keep else versions[:-1])
        if keep_seconds is not None:
            old |= {v for v in versions[:-1] if time.time_ns() - int(v[1:]) > keep_seconds * 1e9}
        drop = [v for v in versions if v in old and v not in head["pinned"]]
        self._set({**head, "current": name, "versions": [v for v in versions if v not in drop]})
        for v in drop:
            self.files.delete(f"{self.path}/{v}")

    def rollback(self, name: str) -> None:
        """Throw a prepared version away."""
        if name in self.versions():
            raise ValueError(f"{name} has been published")
        self.files.delete(f"{self.path}/{name}")

    def commit(self, index: Index, keep: int | None = None) -> str:
        name = self.prepare(index)
        self.publish(name, keep)
        return name

    def open(self, version: str | None = None) -> Index:
        name = version or self._head()["current"]
        if name is None:
            raise FileNotFoundError(f"no version in {self.path}")
        return open_index(self.spark, f"{self.path}/{name}", self.fields)

    def versions(self) -> list[str]:
        return self._head()["versions"]

    def prune(self, keep: int) -> list[str]:
        """Delete all but the latest ``keep`` versions and those that are pinned; what was deleted."""
        head = self._head()
        stay = {*head["versions"][-keep:], *head["pinned"], head["current"]}
        drop = [v for v in head["versions"] if v not in stay]
        self._set({**head, "versions": [v for v in head["versions"] if v in stay]})
        for v in drop:
            self.files.delete(f"{self.path}/{v}")
        return drop

    def formats(self) -> dict[str, str]:
        """What can be done with each version: ``current``, ``old`` (readable, can be migrated) or ``broken``."""
        out = {}
        for name in self.versions():
            if any(not self.files.exists(f"{self.path}/{name}/{t}") for t in self.TABLES):
                out[name] = "broken"
                continue
            have = set(self.spark.read.parquet(f"{self.path}/{name}/postings").columns)
            need = {x.split()[0] for x in _POSTINGS.split(", ")}
            out[name] = "current" if need <= have else "old" if {"field", "term", "doc_id", "tf", "dl"} <= have else "broken"
        return out

    def migrate(self, version: str | None = None) -> str | None:
        """Write an old version anew in the current format and publish it; None where there is nothing to do."""
        name = version or self._head()["current"]
        if self.formats().get(name) != "old":
            return None
        return self.commit(self.open(name))

    def pin(self, name: str) -> None:
        """Keep a version as a snapshot, whatever is published later."""
        head = self._head()
        self._set({**head, "pinned": sorted({*head["pinned"], name})})

    def unpin(self, name: str) -> None:
        head = self._head()
        self._set({**head, "pinned": [v for v in head["pinned"] if v != name]})

    def _sums(self, path: str) -> dict[str, list]:
        """Rows and a checksum of each table, whatever the order of its rows."""
        out = {}
        for name in self.TABLES:
            df = self.spark.read.parquet(f"{path}/{name}")
            whole = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
            out[name] = [str(x) for x in df.agg(F.count(F.lit(1)), F.coalesce(F.sum(whole), F.lit(0))).first()]
        return out

    def _copy(self, source: str, target: str) -> None:
        for name in self.TABLES:
            writer = self.spark.read.parquet(f"{source}/{name}").write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy("field") if name == "postings" else writer).parquet(f"{target}/{name}")

    def backup(self, target: str, version: str | None = None) -> dict:
        """Copy a version with a manifest of row counts and checksums; executors do the copying."""
        name = version or self._head()["current"]
        self._copy(f"{self.path}/{name}", f"{target}/{name}")
        manifest = {"version": name, "tables": self._sums(f"{self.path}/{name}")}
        self.files.create(f"{target}/manifest.json", json.dumps(manifest), overwrite=True)
        return manifest

    def restore(self, source: str) -> str:
        """Check a backup against its manifest and make it current."""
        manifest = json.loads(self.files.read(f"{source}/manifest.json"))
        name = manifest["version"]
        if self._sums(f"{source}/{name}") != manifest["tables"]:
            raise ValueError(f"backup is damaged: {source}")
        if not self.files.exists(f"{self.path}/{name}"):
            self._copy(f"{source}/{name}", f"{self.path}/{name}")
        head = self._head()
        self._set({**head, "current": name, "versions": [v for v in head["versions"] if v != name] + [name]})
        return name

    def sizes(self, version: str | None = None) -> dict[str, int]:
        """Bytes of each table of a version."""
        root = f"{self.path}/{version or self._head()['current']}"
        return {t: self.files.size(f"{root}/{t}") for t in self.files.names(root)}
