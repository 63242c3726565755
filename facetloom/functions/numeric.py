"""Number and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round in binary floating point, halves to the even neighbour."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def clamp01(value: Column) -> Column:
    """Limit to the range 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def l2_normalize(vector: Column) -> Column:
    """Scale an array of numbers to length one; a zero vector stays as it is."""
    norm = F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    )
    return F.when(
        norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))
    ).otherwise(vector.cast("array<float>"))


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays, summed in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
