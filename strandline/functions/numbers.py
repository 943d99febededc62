"""Guarded scalar and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

R_CLIP = 0.999999


def shown(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def clip_r(r: Column) -> Column:
    return F.least(F.greatest(r, F.lit(-R_CLIP)), F.lit(R_CLIP))


def safe_corr(x: str, y: str) -> Column:
    """Pearson r; 0 where a side is constant (corr would divide by zero)."""
    flat = (F.coalesce(F.var_pop(x), F.lit(0.0)) <= 0) | (F.coalesce(F.var_pop(y), F.lit(0.0)) <= 0)
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    top = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    under = F.sqrt((n * F.sum(F.col(x) * F.col(x)) - sx * sx) * (n * F.sum(F.col(y) * F.col(y)) - sy * sy))
    return F.when(flat, F.lit(0.0)).otherwise(clip_r(F.try_divide(top, under)))


def standard_error(x: str) -> Column:
    """Of the mean, with n - 1; 0 for one value."""
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def effect_size(x: str) -> Column:
    """Mean over sample sd; 0 for one value or a sd of at most 1e-12."""
    sd = F.stddev_samp(x)
    return F.when(F.coalesce(sd, F.lit(0.0)) <= 1e-12, F.lit(0.0)).otherwise(F.try_divide(F.avg(x), sd))
