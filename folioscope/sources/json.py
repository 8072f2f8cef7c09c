"""Documents from JSON: nested objects become dotted fields."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package

_FIELDS = "doc_id bigint, field string, value string, kind string"


def flatten(value: Any, name: str = "") -> Iterator[tuple[str, str, str]]:
    """``(field, value, kind)`` of a parsed value.

    Items of an array repeat its field; ``true`` and ``false`` are strings;
    whole numbers are int64, others numeric; null has no field.
    """
    match value:
        case dict():
            for k, v in value.items():
                yield from flatten(v, f"{name}.{k}" if name else k)
        case list():
            for v in value:
                yield from flatten(v, name)
        case bool():
            yield name, "true" if value else "false", "string"
        case int():
            yield name, str(value), "int64" if -(2**63) <= value < 2**63 else "numeric"
        case float():
            yield name, repr(value), "numeric"
        case str():
            yield name, value, "text"


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                rows += [(doc, *f) for f in flatten(json.loads(text))]
            except (TypeError, ValueError):
                continue
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], ["doc_id", "field", "value", "kind"]
        )


def fields(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(doc_id, field, value, kind)`` of JSON texts; null and broken ones have no fields."""
    ship_package(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(column)).mapInArrow(_fields, _FIELDS)


def documents(df: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """A table with one column for each dotted field of a JSON schema, parsed inside Spark."""
    parsed = df.select(F.col(key).cast("long").alias("doc_id"), F.from_json(column, schema).alias("j"))
    out = []

    def walk(kind, path: str) -> None:
        for f in kind.fields:
            at = f"{path}.{f.name}"
            if f.dataType.typeName() == "struct":
                walk(f.dataType, at)
            else:
                out.append(F.col(at).alias(at.removeprefix("j.")))

    walk(parsed.schema["j"].dataType, "j")
    return parsed.select("doc_id", *out)
