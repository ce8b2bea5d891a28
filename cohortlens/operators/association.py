"""Association tests and multiple-testing control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.rates import ratio
from cohortlens.functions.tails import chi2_tail, normal_two_sided
from cohortlens.operators.ordered import ordered_scan, value_histogram


def chi_square(df: DataFrame, factors: list[str], outcome: str) -> DataFrame:
    """Chi-square independence per factor with Cramer's V; rows with a null side are left out.

    The statistic has the continuity correction when dof = 1, V always uses the uncorrected sum.
    Works on cell counts; empty cells are added from the margins (levels x outcome values).
    """
    long = df.select(F.col(outcome).cast("string").alias("_o"), *[F.col(f).cast("string").alias(f) for f in factors])
    cells = (
        long.where(F.col("_o").isNotNull()).unpivot(["_o"], factors, "factor", "level")
        .where(F.col("level").isNotNull())
        .groupBy("factor", "level", "_o").agg(F.count(F.lit(1)).alias("n"))
    )
    # per level the outcome counts as a map, so absent outcomes can be read as 0
    rows = cells.groupBy("factor", "level").agg(
        F.map_from_entries(F.collect_list(F.struct("_o", "n"))).alias("_c"), F.sum("n").alias("_row"))
    margins = (
        cells.groupBy("factor", "_o").agg(F.sum("n").alias("c"))
        .groupBy("factor").agg(F.collect_list(F.struct("_o", "c")).alias("_cols"), F.sum("c").alias("_n"))
    )
    levels = cells.groupBy("factor").agg(F.count_distinct("level").alias("_levels"))
    grid = (
        rows.join(margins, "factor").join(levels, "factor")
        .withColumn("_dof", (F.col("_levels") - 1) * (F.size("_cols") - 1))
        .select("*", F.explode("_cols").alias("_m"))
    )
    observed = F.coalesce(F.try_element_at("_c", F.col("_m._o")), F.lit(0))
    expected = F.col("_row") * F.col("_m.c") / F.col("_n")
    gap = F.abs(observed - expected)
    shrunk = F.when(F.col("_dof") == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    out = grid.groupBy("factor").agg(
        F.sum(shrunk * shrunk / expected).alias("statistic"), F.sum(gap * gap / expected).alias("_raw"),
        F.first("_dof").cast("int").alias("dof"), F.first("_n").alias("n"),
        F.least(F.first("_levels"), F.first(F.size("_cols"))).alias("_k"))
    return out.select(
        F.concat(F.lit("chi2: "), F.col("factor")).alias("test"), "statistic", "dof",
        F.sqrt(ratio(ratio(F.col("_raw"), F.col("n")), F.col("_k") - 1)).alias("effect_size"),
        F.lit("Cramer's V").alias("effect_name"), "n")


def mann_whitney(df: DataFrame, columns: list[str], outcome: str, **scan: object) -> DataFrame:
    """Rank-sum statistic U of the outcome = 1 group per column, its tie-corrected z (with
    continuity correction) and the absolute rank-biserial correlation."""
    y = F.col(outcome)
    hist = value_histogram(df.where(y.isin(0, 1)), columns, {"n1": y.cast("bigint")})
    c = ordered_scan(hist, ["variable"], ["value"], running={"cum": "n"}, **scan)
    t = F.col("n").cast("double")
    agg = c.groupBy("variable").agg(
        F.sum("n").alias("n"), F.sum("n1").alias("_n1"),
        F.sum(F.col("n1") * (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2)).alias("_r1"),
        F.sum(t * t * t - t).alias("_ties"))
    n, n1 = F.col("n").cast("double"), F.col("_n1").cast("double")
    n0 = n - n1
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    mu = n1 * n0 / 2
    var = n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(u, n1 * n0 - u) - mu - F.lit(0.5), F.sqrt(var))
    return agg.select(
        F.concat(F.lit("mannwhitneyu: "), F.col("variable")).alias("test"), u.alias("statistic"),
        F.lit(None).cast("int").alias("dof"), F.abs(1 - ratio(2 * u, n1 * n0)).alias("effect_size"),
        F.lit("rank-biserial").alias("effect_name"), "n", F.greatest(z, F.lit(0.0)).alias("z"))


def adjust_fdr(df: DataFrame, p: str = "p_value", family: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values and the 5 % flag; each family is one result table."""
    whole = Window.partitionBy(*(family or []))
    rank_w = whole.orderBy(F.asc_nulls_last(p))
    step = df.withColumn("_i", F.row_number().over(rank_w)).withColumn("_m", F.count(p).over(whole))
    up = whole.orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    adj = F.least(F.min(F.col(p) * F.col("_m") / F.col("_i")).over(up), F.lit(1.0))
    return step.withColumn("p_adj", F.when(F.col(p).isNotNull(), adj)).withColumn(
        "significant_fdr_05", F.col("p_adj") < 0.05).drop("_i", "_m")


def test_family(df: DataFrame, factors: list[str], numerics: list[str], outcome: str, **scan: object) -> DataFrame:
    """All tests of one outcome with p-values, FDR control and effect sizes, largest effect first."""
    chi = chi_square(df, factors, outcome).withColumn("z", F.lit(None).cast("double"))
    tests = chi.unionByName(mann_whitney(df, numerics, outcome, **scan))
    p: Column = F.coalesce(chi2_tail(F.col("statistic"), F.when(F.col("z").isNull(), F.col("dof"))),
                           normal_two_sided(F.col("z")))
    return adjust_fdr(tests.withColumn("p_value", p)).drop("z").orderBy(F.desc("effect_size"), "test")


test_family.__test__ = False  # not a pytest case
