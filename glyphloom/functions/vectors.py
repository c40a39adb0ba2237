"""Vector column expressions on ARRAY<FLOAT> / ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy (ARRAY<DOUBLE>); the zero vector stays as it is."""
    scaled = lambda n: F.transform(v, lambda x: x.cast("double") / n)
    return let(F.sqrt(dot(v, v)), lambda n: scaled(F.when(n == 0, F.lit(1.0)).otherwise(n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    return let(
        F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)),
        lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n),
    )
