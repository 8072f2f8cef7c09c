"""An index that follows a stream.

Every micro-batch writes the postings of its documents and partial statistics
to folders of its own, named by the batch: a batch that is replayed after a
failure writes the same folder again, so nothing counts twice.  A document that
was in an earlier batch replaces it: the batch lists what it replaces and takes
its terms off the statistics.  Readers see whole batches; statistics are summed
from the partial ones.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..index.build import _POSTINGS, ORDER, Index, indexed, postings_of, term_stats_of
from ..index.schema import FieldSpec
from ..index.segments import Policy, tiered
from ..runtime import Files, one_row_per_id

_GONE = "doc_id bigint, of bigint"


def _batches(spark: SparkSession, path: str) -> set[int]:
    """Batches that are complete (the count of documents is written last) and not merged into others."""
    files = Files(spark)
    done = {int(n.partition("=")[2]) for n in files.names(f"{path}/doc_partial") if n.startswith("batch=") and files.exists(f"{path}/doc_partial/{n}/_SUCCESS")}
    merged = [json.loads(files.read(f"{path}/merges/{n}")) for n in files.names(f"{path}/merges") if n.endswith(".json")]
    # a batch that merging made has a number below 0, and counts once its merge is on record
    made, gone = {m["into"] for m in merged}, {b for m in merged for b in m["of"]}
    return {b for b in done if (b >= 0 or b in made) and b not in gone}


def _read(spark: SparkSession, path: str, name: str, batches: set[int], schema: str | None = None) -> DataFrame:
    """A table of some batches, with the number of each row's batch."""
    reader = spark.read.schema(f"{schema}, batch bigint") if schema else spark.read
    paths = [f"{path}/{name}/batch={b}" for b in sorted(batches)]
    return reader.option("basePath", f"{path}/{name}").parquet(*paths).withColumn("batch", F.col("batch").cast("bigint"))


def append_batch(batch: DataFrame, epoch: int, path: str, fields: list[FieldSpec]) -> None:
    """Add one micro-batch; of a document repeated in it one row counts, the same in every run."""
    spark = batch.sparkSession
    one_row_per_id(batch, "doc_id").write.mode("overwrite").parquet(f"{path}/docs/batch={epoch}")
    own = spark.read.parquet(f"{path}/docs/batch={epoch}")
    text = [f for f in fields if f.kind in ("text", "string")]
    postings_of(own, text).sortWithinPartitions(*ORDER).write.mode("overwrite").parquet(f"{path}/postings/batch={epoch}")
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings/batch={epoch}")
    stats, n = term_stats_of(postings), own.agg(F.count(F.lit(1)).alias("n_docs"))
    before = {b for b in _batches(spark, path) if b < epoch}
    gone = spark.createDataFrame([], _GONE)
    if before:
        had = _live(spark, path, before, _read(spark, path, "docs", before).select("doc_id", "batch"))
        gone = had.join(own.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("batch").alias("of"))
    gone.write.mode("overwrite").parquet(f"{path}/replaced/batch={epoch}")
    gone = spark.read.schema(_GONE).parquet(f"{path}/replaced/batch={epoch}")
    if before and gone.limit(1).count():
        lost = _read(spark, path, "postings", before, _POSTINGS).join(gone.withColumnRenamed("of", "batch"), ["doc_id", "batch"], "left_semi")
        off = term_stats_of(lost).select("field", "term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
        stats = stats.unionByName(off)
        n = n.unionByName(gone.agg((-F.count(F.lit(1))).alias("n_docs")))
    stats.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).write.mode("overwrite").parquet(f"{path}/term_partial/batch={epoch}")
    n.agg(F.sum("n_docs").alias("n_docs")).write.mode("overwrite").parquet(f"{path}/doc_partial/batch={epoch}")


def _live(spark: SparkSession, path: str, batches: set[int], rows: DataFrame) -> DataFrame:
    """Rows ``(doc_id, batch, ...)`` that no later batch replaces."""
    gone = _read(spark, path, "replaced", batches, _GONE).select("doc_id", F.col("of").alias("batch")).distinct()
    return rows.join(gone, ["doc_id", "batch"], "left_anti")


def follow(stream: DataFrame, path: str, fields: list[FieldSpec], every: str | None = None) -> StreamingQuery:
    """Index a stream of documents; ``every`` is a trigger interval, else all that is there is taken once."""
    writer = stream.writeStream.foreachBatch(lambda df, epoch: append_batch(df, epoch, path, fields)).option("checkpointLocation", f"{path}/progress")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def refresh(spark: SparkSession, path: str, fields: list[FieldSpec]) -> Index:
    """The index as of the batches written so far."""
    batches = _batches(spark, path)
    if not batches:
        raise FileNotFoundError(f"no batch in {path}")
    partial = _read(spark, path, "term_partial", batches)
    stats = partial.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    n = _read(spark, path, "doc_partial", batches).agg(F.sum("n_docs").alias("n_docs"))
    sums = partial.groupBy("field").agg(F.sum("cf").alias("sum_dl"))
    names = {f.name: f for f in fields}
    named = spark.createDataFrame([(f,) for f in indexed(names)], "field string")
    avg = F.when(F.coalesce("sum_dl", F.lit(0)) > 0, F.col("sum_dl") / F.col("n_docs")).otherwise(1.0)
    corpus = named.join(F.broadcast(sums), "field", "left").crossJoin(F.broadcast(n)).select(
        "field", "n_docs", F.coalesce("sum_dl", F.lit(0)).alias("sum_dl"), avg.alias("avgdl")
    )
    docs = _live(spark, path, batches, _read(spark, path, "docs", batches)).drop("batch")
    postings = _live(spark, path, batches, _read(spark, path, "postings", batches, _POSTINGS)).drop("batch")
    return Index(docs, postings, stats, corpus, names)


def merge_batches(spark: SparkSession, path: str, policy: Policy = tiered()) -> list[list[int]]:
    """Merge the batches that a policy chooses; what was merged.

    A merged batch holds the live documents of its parts.  Readers see it when
    the record of the merge is there, which is one small file.  Run it between
    micro-batches: one that is under way must not lose what it replaces.
    """
    files = Files(spark)
    batches = _batches(spark, path)
    groups = policy({b: files.size(f"{path}/postings/batch={b}") for b in batches})
    for of in groups:
        into = min([0, *_batches(spark, path), *[int(n.partition("=")[2]) for n in files.names(f"{path}/docs")]]) - 1
        now = _batches(spark, path)
        for name, schema in (("docs", None), ("postings", _POSTINGS)):
            rows = _live(spark, path, now, _read(spark, path, name, set(of), schema)).drop("batch")
            if name == "postings":
                rows = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={into}")
        # what the parts replaced outside themselves stays replaced
        gone = _read(spark, path, "replaced", set(of), _GONE).where(~F.col("of").isin(of)).select("doc_id", "of")
        gone.write.mode("overwrite").parquet(f"{path}/replaced/batch={into}")
        sums = _read(spark, path, "term_partial", set(of)).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        sums.write.mode("overwrite").parquet(f"{path}/term_partial/batch={into}")
        n = _read(spark, path, "doc_partial", set(of)).agg(F.sum("n_docs").alias("n_docs"))
        n.write.mode("overwrite").parquet(f"{path}/doc_partial/batch={into}")
        files.create(f"{path}/merges/{-into:012d}.json", json.dumps({"into": into, "of": sorted(of)}))
    return groups


def changed(spark: SparkSession, path: str, seen: set[int]) -> bool:
    """Whether batches beyond ``seen`` are there (then refresh)."""
    return _batches(spark, path) != seen
