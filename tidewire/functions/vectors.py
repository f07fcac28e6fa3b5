"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """``v`` divided by its length; the zero vector stays."""
    # in an array of one, so that it is not computed again for every element
    lengths = F.array(F.sqrt(dot(v, v)))
    return F.element_at(F.transform(lengths, lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))), 1)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot of unit vectors, within [0, 2]."""
    return F.least(F.greatest(1 - dot(a, b), F.lit(0.0)), F.lit(2.0))
