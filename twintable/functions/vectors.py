"""Vector arithmetic on array columns, JVM-side."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_doubles(x: Column | str) -> Column:
    """An array of any number type as array<double>."""
    return _c(x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = l2_norm(a)
    return F.when(n == 0, _c(a)).otherwise(F.transform(_c(a), lambda x: x / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 for a null or zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def cosine_of_distance(d: Column | str) -> Column:
    """Cosine of unit vectors at this Euclidean distance."""
    return 1 - F.pow(_c(d), F.lit(2)) / 2


def distance_of_cosine(t: float) -> float:
    """Euclidean distance of unit vectors with this cosine."""
    return sqrt(max(0.0, 2 * (1 - t)))


def is_usable(v: Column | str, dims: int) -> Column:
    """Exactly ``dims`` finite numbers that are not all zero."""
    c = _c(v)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) == dims) & fine & F.exists(c, lambda x: x != 0)
