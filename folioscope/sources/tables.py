"""Reading and writing collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CODECS = ("none", "snappy", "zstd", "lz4", "gzip")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table in any of Spark's formats; give a schema for text formats to spare the inference pass."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", codec: str = "zstd", by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    if codec not in CODECS:
        raise ValueError(f"unknown codec: {codec}")
    writer = df.write.format(kind).mode(mode)
    if kind in ("parquet", "orc"):
        writer = writer.option("compression", codec)
    (writer.partitionBy(*by) if by else writer).save(path)
