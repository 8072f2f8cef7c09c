"""Fields of a collection, their validation, and encoders of typed values."""

from __future__ import annotations

import dataclasses
import datetime as dt
import typing
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..analysis.analyser import Analyser, standard

KINDS = ("text", "string", "numeric", "int64", "vector", "geo", "stored", "binary")
_ACCEPTS = {
    "text": (T.StringType, T.ArrayType), "string": (T.StringType, T.ArrayType), "stored": (T.DataType,), "binary": (T.BinaryType,),
    "numeric": (T.NumericType, T.ArrayType), "int64": (T.IntegralType, T.ArrayType), "vector": (T.ArrayType,), "geo": (T.StructType,),
}


@dataclass(frozen=True)
class FieldSpec:
    """One field: its kind, analyser, boost, and whether every document needs it."""

    name: str
    kind: str = "text"
    analyser: Analyser = field(default_factory=standard)
    boost: float = 1.0
    required: bool = False
    #: Keep where each term begins and ends in the text, for highlighting.
    offsets: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of field: {self.kind}")


@dataclass(frozen=True)
class Schema:
    """A set of fields; ``strict`` rejects columns that are not among them."""

    fields: tuple[FieldSpec, ...]
    strict: bool = False

    def problems(self, df: DataFrame, key: str = "doc_id") -> list[str]:
        """What is wrong with the columns of a table."""
        have = {f.name: f.dataType for f in df.schema.fields}
        out = [f"missing column: {f.name}" for f in self.fields if f.required and f.name not in have]
        for f in self.fields:
            if f.name in have and not isinstance(have[f.name], _ACCEPTS[f.kind]):
                out.append(f"column {f.name} is {have[f.name].simpleString()}, not {f.kind}")
        if self.strict:
            known = {f.name for f in self.fields} | {key}
            out += [f"unexpected column: {c}" for c in have if c not in known]
        return out

    def violations(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """``(doc_id, problem)``: rows that lack a value they need."""
        checks = [F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is null")) for f in self.fields if f.required and f.name in df.columns]
        if not checks:
            return df.select(F.col(key).alias("doc_id"), F.lit("").alias("problem")).where("false")
        return df.select(F.col(key).alias("doc_id"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))

    def validated(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """``df``, or an error: at once for its columns, in the job for its rows."""
        found = self.problems(df, key)
        if found:
            raise ValueError("; ".join(found))
        for f in self.fields:
            if f.required:
                df = df.withColumn(f.name, F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{f.name} is null")).cast(df.schema[f.name].dataType)))
        return df


#: Ticks of 100 ns from year 1 to 1970.
_EPOCH_TICKS = 621_355_968_000_000_000

ENCODERS: dict[str, Callable[[Column], Column]] = {
    "unix_millis": F.unix_millis,
    "unix_seconds": F.unix_seconds,
    "ticks": lambda c: F.unix_micros(c) * 10 + _EPOCH_TICKS,
    "day_number": lambda c: F.date_diff(c, F.to_date(F.lit("0001-01-01"))),
    "decimal_string": lambda c: c.cast("string"),
    "flag": lambda c: F.when(c, "true").otherwise("false"),
}
DECODERS: dict[str, Callable[[Column], Column]] = {
    "unix_millis": F.timestamp_millis,
    "unix_seconds": F.timestamp_seconds,
    "ticks": lambda c: F.timestamp_micros(((c - _EPOCH_TICKS) / 10).cast("long")),
    "day_number": lambda c: F.date_add(F.to_date(F.lit("0001-01-01")), c),
    "decimal_string": lambda c: c.cast("decimal(38,18)"),
    "flag": lambda c: c == "true",
}

_KIND_OF = {
    str: "string", int: "int64", float: "numeric", bool: "string", bytes: "binary", Decimal: "stored",
    dt.datetime: "int64", dt.date: "int64",
}


def schema_of(model: type, strict: bool = False) -> Schema:
    """The schema of a dataclass.

    A field's metadata may name its ``kind``, ``boost`` or ``analyser``, or set
    ``ignore``; otherwise its type decides.  Fields without a default are
    required.
    """
    hints = typing.get_type_hints(model)
    out = []
    for f in dataclasses.fields(model):
        if f.metadata.get("ignore"):
            continue
        kind = hints[f.name]
        args = [a for a in typing.get_args(kind) if a is not type(None)]
        optional = len(args) < len(typing.get_args(kind))
        base = args[0] if args else kind
        default = _KIND_OF.get(base, "stored")
        if typing.get_origin(kind) is list and base is float:
            default = "vector"
        needed = f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and not optional
        options = {k: f.metadata[k] for k in ("boost", "analyser") if k in f.metadata}
        out.append(FieldSpec(f.name, f.metadata.get("kind", default), required=needed, **options))
    return Schema(tuple(out), strict)
