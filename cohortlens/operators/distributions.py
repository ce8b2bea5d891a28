"""Candidate distributions for a numeric column, fitted from aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.functions.tails import chi2_sf, log_gamma
from cohortlens.operators.ordered import ordered_scan, value_histogram


def poisson_vs_negbin(df: DataFrame, column: str) -> DataFrame:
    """Poisson against moment-fitted negative binomial for a count column, one row.

    The distinct-value counts are sufficient; log-gamma runs once per distinct value. The p-value
    is half the chi-square(1) tail since the null lies on the boundary.
    """
    hist = df.select(F.col(column).cast("long").alias("x")).where(F.col("x").isNotNull()).groupBy("x").agg(
        F.count(F.lit(1)).alias("c"))
    moments = df.agg(
        F.count(column).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v")).first()
    n, m, v = moments["n"], float(moments["m"]), float(moments["v"])
    r = m * m / max(v - m, 1e-9)
    p = r / (r + m)
    x, c = F.col("x").cast("double"), F.col("c")
    fact = log_gamma(x + 1)
    ll = hist.agg(
        F.sum(c * (x * math.log(m) - m - fact)).alias("loglik_poisson"),
        F.sum(c * (log_gamma(x + F.lit(r)) - math.lgamma(r) - fact + r * math.log(p)
                   + x * math.log1p(-p))).alias("loglik_negbin"))
    out = ll.withColumn("lr_statistic", 2 * (F.col("loglik_negbin") - F.col("loglik_poisson")))
    half_tail = F.pandas_udf(lambda s: s.map(lambda a: 0.5 * chi2_sf(a, 1)), T.DoubleType())
    return out.select(
        F.lit(n).cast("bigint").alias("n"), F.lit(m).alias("mean"), F.lit(v).alias("variance"),
        F.lit(v / m).alias("dispersion_ratio"), F.lit(r).alias("nb_dispersion_r"),
        "loglik_poisson", "loglik_negbin", "lr_statistic", half_tail("lr_statistic").alias("p_value"),
        (2 - 2 * F.col("loglik_poisson")).alias("aic_poisson"), (4 - 2 * F.col("loglik_negbin")).alias("aic_negbin"))


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def _lower_gamma(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    x = np.asarray(x, dtype=float)
    out = np.empty_like(x)
    with np.errstate(divide="ignore"):  # zero gives zero
        lead = np.exp(-x + a * np.log(x) - math.lgamma(a))
    low = x < a + 1
    term = np.full(low.sum(), 1 / a)
    total, k = term.copy(), a
    for _ in range(500):
        k += 1
        term = term * x[low] / k
        total += term
        if not term.size or (term < total * 1e-15).all():
            break
    out[low] = lead[low] * total
    z = x[~low]
    b = z + 1 - a
    c, d = np.full_like(z, 1e300), 1 / b
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - a)
        b = b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if not z.size or (np.abs(d * c - 1) < 1e-15).all():
            break
    out[~low] = 1 - lead[~low] * h
    return out


#: Shapes tried in one pass.
SHAPES = 33


def _power_sums(cum: DataFrame, top: float, shapes: np.ndarray) -> np.ndarray:
    """(sum of n z^k, sum of n z^k ln z) at every shape k, with z = value / top; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(shapes)))
        for batch in batches:
            lz, w = np.log(batch.column(0).to_numpy() / top), batch.column(1).to_numpy()
            for i in range(0, len(lz), 4_096):
                power = w[i: i + 4_096, None] * np.exp(lz[i: i + 4_096, None] * shapes)
                total += power.sum(0), (power * lz[i: i + 4_096, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "s"])

    rows = cum.select("value", F.col("n").cast("double").alias("n")).mapInArrow(run, "i bigint, s double").groupBy("i").agg(F.sum("s")).collect()
    return np.array([v for _, v in sorted(map(tuple, rows))]).reshape(2, -1)


def _weibull_shape(cum: DataFrame, top: float, mean_log: float, guess: float) -> tuple[float, float]:
    """Shape k of the Weibull fit and the sum of n z^k there.

    The likelihood equation rises with k. A pass evaluates it at many shapes, the next one between the
    two around its root; three passes narrow it to a millionth, and a line through the ends finishes.
    """
    low, high = guess / 4, guess * 4
    while True:
        shapes = np.geomspace(low, high, SHAPES)
        a, b = _power_sums(cum, top, shapes)
        f = b / a - 1 / shapes - mean_log
        if f[0] > 0:
            low, high = low / 64, shapes[0]
        elif f[-1] < 0:
            low, high = shapes[-1], high * 64
        else:
            i = min(max(int(np.searchsorted(f, 0.0)), 1), SHAPES - 1)
            low, high = shapes[i - 1], shapes[i]
            share = -f[i - 1] / (f[i] - f[i - 1])
            if high / low - 1 < 1e-5:
                # powers change smoothly with the shape
                return float(low + share * (high - low)), float(np.exp((1 - share) * np.log(a[i - 1]) + share * np.log(a[i])))


def continuous_fits(df: DataFrame, column: str, **scan: object) -> DataFrame:
    """Maximum-likelihood normal, lognormal, gamma and Weibull fits of the positive values:
    log-likelihood, AIC, BIC, Kolmogorov-Smirnov distance, AIC difference; best first.

    Location is fixed at 0 for the positive families. Parameters come from sums over the value
    histogram, the Weibull shape from its power sums at many shapes a pass.
    """
    hist = value_histogram(df.where(F.col(column) > 0), [column])
    cum = ordered_scan(hist, ["variable"], ["value"], running={"_cum": "n"}, totals={"_all": "n"},
                       **scan).persist()
    try:
        return _continuous_fits(cum)
    finally:
        cum.unpersist()


def _continuous_fits(cum: DataFrame) -> DataFrame:
    x, w = F.col("value"), F.col("n").cast("double")
    s = cum.agg(F.sum(w).alias("n"), (F.sum(w * x) / F.sum(w)).alias("m"), F.sum(w * F.ln(x)).alias("sl"),
                F.max(x).alias("top")).first()
    n, m, mean_log = s["n"], s["m"], s["sl"] / s["n"]
    # second pass around the means keeps the variances accurate
    d = cum.agg(F.sum(w * (x - m) ** 2).alias("ss"), F.sum(w * (F.ln(x) - mean_log) ** 2).alias("sl2")).first()
    var, var_log = d["ss"] / n, d["sl2"] / n
    if var == 0:
        raise ValueError("a constant column has no continuous fit")

    g = math.log(m) - mean_log
    a = (3 - g + math.sqrt((g - 3) ** 2 + 24 * g)) / (12 * g)
    for _ in range(50):
        step = (math.log(a) - _digamma(a) - g) / (1 / a - _trigamma(a))
        a = a - step if a - step > 0 else a / 2
        if abs(step) < 1e-12 * a:
            break
    theta = m / a

    top = s["top"]  # scaling by the maximum keeps powers finite
    k, power = _weibull_shape(cum, top, mean_log - math.log(top), 1.2 / math.sqrt(var_log))
    scale = top * (power / n) ** (1 / k)

    ll = {
        "normal": -n / 2 * (math.log(2 * math.pi * var) + 1),
        "lognormal": -n / 2 * (math.log(2 * math.pi * var_log) + 1) - s["sl"],
        "gamma": (a - 1) * s["sl"] - n * m / theta - n * (a * math.log(theta) + math.lgamma(a)),
        "weibull": n * (math.log(k) - k * math.log(scale)) + (k - 1) * s["sl"] - n,
    }
    sd, sd_log = math.sqrt(var), math.sqrt(var_log)

    def phi(t: np.ndarray) -> np.ndarray:
        return 0.5 + 0.5 * np.sign(t) * _lower_gamma(0.5, t * t / 2)

    def gaps(batches):
        for b in batches:
            v = b["value"].to_numpy()
            hi, lo = b["_cum"].to_numpy() / n, (b["_cum"] - b["n"]).to_numpy() / n
            cdf = {
                "normal": phi((v - m) / sd), "lognormal": phi((np.log(v) - mean_log) / sd_log),
                "gamma": _lower_gamma(a, v / theta), "weibull": -np.expm1(-((v / scale) ** k)),
            }
            yield pd.DataFrame([(d, float(np.max(np.maximum(np.abs(hi - p), np.abs(p - lo))))) for d, p in cdf.items()
                                if len(p)], columns=["distribution", "gap"])

    ks = {r["distribution"]: r["ks"] for r in cum.select("value", "n", "_cum")
          .mapInPandas(gaps, "distribution string, gap double").groupBy("distribution").agg(F.max("gap").alias("ks"))
          .collect()}
    best = min(4 - 2 * v for v in ll.values())
    rows = [(d, 2, float(v), 4 - 2 * v, 2 * math.log(n) - 2 * v, ks[d], 4 - 2 * v - best) for d, v in ll.items()]
    return cum.sparkSession.createDataFrame(
        sorted(rows, key=lambda r: r[3]),
        "distribution string, n_params int, loglik double, aic double, bic double, ks_stat double, delta_aic double")
