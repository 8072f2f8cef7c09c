"""Session-level plumbing: the shared folder, stage tables, record identity.

A *stage table* is a DataFrame written once to the folder that the cluster
names in ``spark.checkpoint.dir`` and read back.  It cuts the lineage (a lost
executor costs only the tasks it was running, never the stages before), it is
columnar, and its size is known to the planner, so joins against it are
broadcast only below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session that leaves the setting unset (tests, notebooks) gets
    a folder of its own under the system's temporary directory; on a cluster
    that is an error, as other machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    own = Path(tempfile.gettempdir()) / f"folioscope-{spark.sparkContext.applicationId}"
    own.mkdir(parents=True, exist_ok=True)
    spark.sparkContext.setCheckpointDir(own.as_uri())
    return own.as_uri()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a stage table and return it read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stages() -> None:
    """Remove every stage table of this process (runs at exit as well)."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            Files(spark).delete(path)
        except Exception:
            pass


atexit.register(drop_stages)


class Files:
    """Small files and folders on any filesystem Spark knows (HDFS, object stores, local disks)."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        """What is in a folder; nothing where there is none."""
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def size(self, path: str) -> int:
        fs, where = self._at(path)
        return fs.getContentSummary(where).getLength()

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, overwrite: bool = False) -> None:
        """Write a file; without ``overwrite`` one that exists is an error (of the filesystem, so two writers cannot both win)."""
        fs, where = self._at(path)
        stream = fs.create(where, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Give Spark's Python workers this package, once per application.

    Nothing is sent where PYTHONPATH leads them to it already.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(sc.applicationId)
    target = Path(tempfile.mkdtemp(prefix="folioscope-")) / "folioscope_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(target))


def one_row_per_id(df: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Keep one row for each value of ``key``; rows without a key are left out.

    Only the key column is shuffled to find the repeated ids, which are staged
    so their size is known; the wide rows of ids that occur once never move
    when that table is small.  Among repeated rows the first by ``order`` is
    kept, then by the hash of all columns, so that the choice is stable.
    """
    df = df.where(F.col(key).isNotNull())
    repeated = stage(
        df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key), "repeated"
    )
    once = df.join(repeated, key, "left_anti")
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    rank = F.struct(*(order or []), tie)
    kept = (
        df.join(repeated, key, "left_semi")
        .groupBy(key)
        .agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), rank).alias("_row"))
        .select("_row.*")
    )
    return once.unionByName(kept)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where few files would leave most of them idle.

    Files that make fewer splits than there are cores are small beside the
    cluster, so moving their rows once is cheap; larger inputs stay as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for f in files:
        where = jvm.org.apache.hadoop.fs.Path(f)
        size += where.getFileSystem(conf).getFileStatus(where).getLen()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if 100_000 < size < cores * split else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables (a Parquet file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
