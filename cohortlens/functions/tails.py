"""Tail probabilities for result tables, applied per row of a few-row DataFrame.

Neither a normal nor a chi-square tail is built into Spark SQL, so these are vectorised
Pandas functions; they run over one row per test, never over the data.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of chi-square for integer degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    if dof % 2:
        total = math.erfc(math.sqrt(h))
        terms = [math.exp(-h + (i - 0.5) * math.log(h) - math.lgamma(i + 0.5)) for i in range(1, (dof - 1) // 2 + 1)]
    else:
        total = 0.0
        terms = [math.exp(-h + i * math.log(h) - math.lgamma(i + 1)) for i in range(dof // 2)]
    return min(1.0, total + sum(terms))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, int(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, dof)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= z) for z >= 0, capped at 1."""
    return pd.Series([min(1.0, math.erfc(a / math.sqrt(2))) if pd.notna(a) else None for a in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)
