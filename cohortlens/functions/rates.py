"""Rates and their intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: 97.5 % point of the standard normal.
Z95 = 1.959963984540054


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Rate, low and high of the Wilson score interval; three nulls for an empty total."""
    n, k = total.cast("double"), successes.cast("double")
    p = ratio(k, n)
    z2 = z * z
    scale = F.lit(1.0) + F.try_divide(F.lit(z2), n)
    centre = (p + F.try_divide(F.lit(z2 / 2), n)) / scale
    half = F.lit(z) / scale * F.sqrt(
        F.greatest(F.try_divide(p * (F.lit(1.0) - p), n), F.lit(0.0)) + F.try_divide(F.lit(z2 / 4), n * n))
    low = F.when(n > 0, F.when(k == 0, F.lit(0.0)).otherwise(centre - half))
    high = F.when(n > 0, F.when(k == n, F.lit(1.0)).otherwise(centre + half))
    return p, low, high


def wald(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high of the normal-approximation interval around a proportion."""
    half = F.lit(z) * F.sqrt(F.greatest(ratio(p * (F.lit(1.0) - p), n), F.lit(0.0)))
    return p - half, p + half


def pooled_d(n1: Column, m1: Column, v1: Column, n0: Column, m0: Column, v0: Column) -> Column:
    """Standardised mean difference with pooled variance; null when that is 0 or undefined."""
    pooled = F.sqrt(ratio((n1 - 1) * v1 + (n0 - 1) * v0, n1 + n0 - 2))
    return ratio(m1 - m0, pooled)


def adjusted_rand(s: Column, a: Column, b: Column, pairs: Column) -> Column:
    """Adjusted Rand index from pair counts: both, first, second labeling, all pairs."""
    expected = a * b / pairs
    return F.coalesce(F.try_divide(s - expected, (a + b) / 2 - expected), F.lit(1.0))
