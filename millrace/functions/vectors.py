"""Dense and sparse vector Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a, b) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Null if either is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(c) -> Column:
    return col(c).cast("array<float>")


def sparse(c) -> Column:
    """{token: weight} as {int: double}, positive weights only."""
    return F.map_filter(F.transform_keys(col(c), lambda k, _: k.cast("int")).cast("map<int,double>"), lambda _, w: w > 0)
