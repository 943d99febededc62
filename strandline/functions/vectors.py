"""Vector algebra on array<double> columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12
EPSILON = 1e-8


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def normalised(v: Column) -> Column:
    """Unit length; a norm under the floor counts as the floor."""
    return bound(v, lambda u: bound(F.greatest(norm(u), F.lit(NORM_FLOOR)), lambda size: F.transform(u, lambda x: x / size)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def half_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def orthogonal_residual(raw: Column, shared: Column) -> Column:
    """What is left of raw - shared after taking out its part along shared."""

    def without(rest: Column) -> Column:
        part = dot(shared, rest) / (dot(shared, shared) + F.lit(EPSILON))
        return bound(part, lambda p: F.zip_with(rest, shared, lambda r, s: r - p * s))

    return bound(minus(raw, shared), without)


def cosine_clipped(a: Column, b: Column) -> Column:
    """Dot of unit vectors, within -1 and 1."""
    return F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))


def weighted(v: Column) -> Column:
    """sum of (i + 1) * v[i]: one number that depends on every place."""
    return F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
