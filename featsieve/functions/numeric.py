"""Numeric helpers that are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(c: Column) -> Column:
    """NaN and the infinities become null, everything else a double."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or ``default`` when undefined."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))


def digamma_int(n: Column) -> Column:
    """psi(n) for integers n >= 1: shifted by 16, then the asymptotic series (error < 1e-12)."""
    x = n.cast("double")
    y = x + F.lit(16.0)
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - 1 / (252 * y * y * y * y * y * y)
    back = F.lit(0.0)
    for i in range(16):
        back = back + 1 / (x + F.lit(float(i)))
    return series - back
