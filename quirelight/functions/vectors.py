"""Vectors as array columns, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def truncated(a: Column, dims: int) -> Column:
    """The first ``dims`` components at unit length; a shorter vector is an error, a zero one stays."""
    head = F.transform(F.slice(a, 1, dims), lambda x: x.cast("double"))
    length = norm(head)
    short = F.raise_error(F.concat(F.lit(f"vector has fewer than {dims} dimensions: "), F.size(a).cast("string"))).cast("array<double>")
    return F.when(F.size(a) < dims, short).otherwise(F.when(length > 0, F.transform(head, lambda x: x / length)).otherwise(head))
