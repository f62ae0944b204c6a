"""Column functions on vectors, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def quantised(a: Column) -> Column:
    """Each component as 0 to 255 between the vector's extremes, halves to even; all 0 for a flat vector."""
    low, high = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    return F.transform(a, lambda x: F.when(high > low, F.rint((x.cast("double") - low) * 255 / (high - low))).otherwise(0.0).cast("int"))


def dequantised(q: Column, low: Column, high: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * (high - low) / 255 + low)
