"""Scalar and aggregate expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(c: Column, floor: float) -> Column:
    """Lower clip that keeps NULL (``greatest`` alone would replace it)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def at_most(c: Column, cap: float) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(cap)))


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def huber(x: Column, delta: float) -> Column:
    a = F.abs(x)
    return F.when(a <= delta, 0.5 * x * x).otherwise(delta * (a - 0.5 * delta))


def smooth_abs(x: Column, eps: float = 1e-4) -> Column:
    return F.sqrt(x * x + eps * eps) - eps


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate that is NULL, not an error, on a constant side."""
    x = F.when(y.isNotNull(), x)
    y = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def sharpe(r: Column, months: int = 12) -> Column:
    return F.try_divide(F.avg(r), F.stddev_samp(r)) * F.lit(float(months) ** 0.5)


def slug(s: str) -> str:
    return re.sub(r"[\W_]", "_", s).strip("_").lower()
