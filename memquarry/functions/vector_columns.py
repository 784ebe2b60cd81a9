"""Column builders for vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def sq8_scale(v: Column) -> Column:
    """The quantiser's step: max |v| / 127 in single precision, 1 for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(top > 0, (top / F.lit(127.0)).cast("float")).otherwise(F.lit(1.0).cast("float"))


def sq8_codes(v: Column, scale: Column) -> Column:
    """Each component in steps, rounded half away from zero, within -127..127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round((x / scale).cast("float").cast("double")))).cast("int"))


def sq8_decode(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda q: (q.cast("float") * scale).cast("float"))
