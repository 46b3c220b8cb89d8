"""Vector functions as Spark columns; all in double unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; null where it is zero or not finite."""
    # the norm is bound once: inside the inner lambda it would be computed anew for each element
    scaled = F.transform(F.array(norm(a)), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n)))
    return F.element_at(scaled, 1)
