"""Logistic inference: coefficients, intervals, fit statistics, nested tests, calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.functions.cleaning import clipped_logit
from cohortlens.functions.rates import Z95
from cohortlens.functions.tails import chi2_tail
from cohortlens.operators.association import adjust_fdr
from cohortlens.operators.encode import design_columns
from cohortlens.operators.profile import cooccurrence
from cohortlens.operators.quality import require_domain
from cohortlens.session import discard, is_scan, materialize

#: A larger model's likelihood may fall short of a smaller one's by so much (rounding of two converged fits).
LIKELIHOOD_SLACK = 1e-6


@dataclass
class LogitFit:
    """An unpenalised logistic fit: driver-side numbers only, one entry per term."""

    outcome: str
    terms: list[str]
    coef: list[float]
    se: list[float]
    p_value: list[float]
    n: int
    loglik: float
    null_loglik: float

    @property
    def df_model(self) -> int:
        return len(self.terms) - 1

    @property
    def mcfadden_r2(self) -> float:
        return 1 - self.loglik / self.null_loglik

    def rows(self) -> list[tuple]:
        def bounded_exp(v: float) -> float:
            return math.exp(v) if v < 709 else float("inf")
        return [(self.outcome, t, b, bounded_exp(b), bounded_exp(b - Z95 * s), bounded_exp(b + Z95 * s), p)
                for t, b, s, p in zip(self.terms, self.coef, self.se, self.p_value)]


ODDS_SCHEMA = ("outcome string, term string, coef double, odds_ratio double, ci_low double, ci_high double, "
               "p_value double")


def fit_logit(df: DataFrame, outcome: str, columns: list[str], categorical: list[str] = (), max_iter: int = 60) -> LogitFit:
    """Fit by iteratively reweighted least squares; raises when it does not converge."""
    wide, terms = design_columns(df, list(columns), list(categorical))
    vec = VectorAssembler(inputCols=[f"x_{t}" for t in terms], outputCol="_x").transform(wide)
    data = vec.select("_x", F.col(outcome).cast("double").alias("_y"))
    if not is_scan(data):  # every iteration and statistic reads it
        data = materialize(data)
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_x", labelCol="_y", maxIter=max_iter, tol=1e-10)
    model = glm.fit(data)
    s = model.summary
    if s.numIterations >= max_iter:
        raise RuntimeError(f"logistic model did not converge: {outcome}")
    # Spark lists the intercept last
    last = len(terms)
    order = [last, *range(last)]
    coef = [*model.coefficients, model.intercept]
    se, p = s.coefficientStandardErrors, s.pValues
    fit = LogitFit(outcome, ["const", *terms], [float(coef[i]) for i in order], [float(se[i]) for i in order],
                   [float(p[i]) for i in order], s.numInstances, -s.deviance / 2, -s.nullDeviance / 2)
    discard(data)
    return fit


def odds_table(spark: SparkSession, fits: list[LogitFit]) -> DataFrame:
    return spark.createDataFrame([r for f in fits for r in f.rows()], ODDS_SCHEMA)


def fit_statistics(spark: SparkSession, fits: list[LogitFit]) -> DataFrame:
    rows = [(f.outcome, int(f.n), f.df_model, f.loglik, f.null_loglik, f.mcfadden_r2) for f in fits]
    return spark.createDataFrame(
        rows, "outcome string, n long, df_model int, loglik double, null_loglik double, mcfadden_r2 double")


def step_tests(stats: DataFrame) -> DataFrame:
    """Likelihood-ratio test of every model against the one before it.

    ``stats``: one row per model with ``step`` (its place), ``n``, ``df_model`` and ``loglik``. Raises
    when a step does not keep the rows, adds no term, or fits worse than rounding explains.
    """
    before = Window.orderBy("step")
    steps = stats.select("*", *[F.lag(c).over(before).alias(f"_{c}") for c in ("n", "df_model", "loglik")]).where("_n IS NOT NULL")
    gain = 2 * (F.col("loglik") - F.col("_loglik"))
    added = F.col("df_model") - F.col("_df_model")
    nested = (F.col("n") == F.col("_n")) & (added > 0) & (gain >= -LIKELIHOOD_SLACK)
    tested = steps.select(*stats.columns, nested.alias("nested"), F.greatest(gain, F.lit(0.0)).alias("lr_statistic"), added.cast("int").alias("df"))
    require_domain(tested, {"nested": F.col("nested")})
    return tested.drop("nested").withColumn("p_value", chi2_tail("lr_statistic", "df"))


def nested_table(df: DataFrame, outcome: str, blocks: dict[str, list[str]], categorical: list[str]) -> DataFrame:
    """Add blocks of columns one after the other and test each step.

    The first block is the base; each later block is a comparison named by its key.
    """
    so_far: list[str] = []
    rows = []
    for step, (name, columns) in enumerate(blocks.items()):
        so_far = so_far + columns
        fit = fit_logit(df, outcome, so_far, categorical)
        rows.append((outcome, name, step, int(fit.n), int(fit.df_model), float(fit.loglik)))
    stats = df.sparkSession.createDataFrame(rows, "outcome string, comparison string, step int, n long, df_model int, loglik double")
    return step_tests(stats).select("outcome", "comparison", "n", "lr_statistic", "df", "p_value")


def calibration_line(df: DataFrame, label: str, models: list[str]) -> DataFrame:
    """Intercept and slope of the label on the logit of each probability column; ideal is 0 and 1."""
    rows = []
    for m in models:
        fit = fit_logit(df.select(label, clipped_logit(F.col(m)).alias("logit_p")), label, ["logit_p"])
        rows.append((m, fit.coef[0], fit.coef[1]))
    return df.sparkSession.createDataFrame(
        rows, "model string, calibration_intercept double, calibration_slope double")


def comorbidity_table(df: DataFrame, outcomes: list[str], features: list[str], categorical: list[str]) -> DataFrame:
    """Directed condition pairs: co-occurrence, lift and the odds ratio adjusted for ``features``
    and the other conditions, with FDR over the table."""
    rows = []
    for y in outcomes:
        others = [c for c in outcomes if c != y]
        fit = fit_logit(df, y, features + others, categorical)
        rows += [(y, t, orat, lo, hi, p) for (_, t, _, orat, lo, hi, p) in fit.rows() if t in others]
    odds = df.sparkSession.createDataFrame(
        rows, "condition string, given string, adjusted_odds_ratio double, or_ci_low double, or_ci_high double, p_value double")
    pairs = cooccurrence(df, outcomes).where(F.col("given") != F.col("condition"))
    joined = pairs.join(F.broadcast(odds), ["given", "condition"])  # k(k-1) rows
    return adjust_fdr(joined).drop("significant_fdr_05").withColumnsRenamed(
        {"condition": "outcome", "given": "existing_condition", "p_adj": "p_adj_bh"})
