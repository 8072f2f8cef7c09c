"""Vector arithmetic on array columns, and quantised vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where the dimensions differ or a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / lengths).otherwise(0.0)


def int8(a: Column, low: Column, step: Column) -> Column:
    """Each component as a whole number of steps above ``low``, 0 to 255."""
    return F.transform(a, lambda x: F.least(F.greatest(F.round((x.cast("double") - low) / step), F.lit(0)), F.lit(255)).cast("smallint"))


def from_int8(q: Column, low: Column, step: Column) -> Column:
    return F.transform(q, lambda x: low + x * step)


def sign_bits(a: Column, centre: Column) -> Column:
    """Signs against a centre, 32 to a long."""
    signs = F.zip_with(a, centre, lambda x, c: (x > c).cast("long"))
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / 32).cast("int") - 1, F.lit(0)))
    pack = lambda w: F.aggregate(F.slice(signs, w * 32 + 1, F.lit(32)), F.lit(0).cast("long"), lambda s, x: s * 2 + x)
    return F.transform(words, pack)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
