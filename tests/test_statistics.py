"""Tests, fits and regressions against closed forms and plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.tails import chi2_sf
from cohortlens.operators import association as A, correlation, distributions, profile, regression as R
from cohortlens.plans import survey as S


def test_chi2_tails():
    assert chi2_sf(10, 3) == pytest.approx(0.0185661, abs=1e-7)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(10, 4) == pytest.approx(math.exp(-5) * 6)
    assert chi2_sf(0, 2) == 1


def test_step_tests(spark):
    def tested(*models):
        return R.step_tests(spark.createDataFrame([(i, *m) for i, m in enumerate(models)], "step int, n long, df_model int, loglik double")).collect()

    (t,) = tested((100, 2, -40.0), (100, 5, -35.0))
    assert (t.lr_statistic, t.df) == (10, 3) and t.p_value == pytest.approx(0.018566, abs=1e-6)
    for later in [(99, 5, -35.0), (100, 2, -35.0), (100, 5, -41.0)]:
        with pytest.raises(ValueError):
            tested((100, 2, -40.0), later)


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.7 * x - 0.5 + 0.4 * (z == 2))))).astype(int)
    c = rng.poisson(2, n)
    df = spark.createDataFrame([(i, int(a), float(b), int(k), int(q)) for i, (a, b, k, q) in enumerate(zip(y, x, z, c))],
                               "k long, y int, x double, z int, c int")
    return df, y, x, z, c


def chi(tab, correct):
    e = np.outer(tab.sum(1), tab.sum(0)) / tab.sum()
    d = np.abs(tab - e)
    return ((d - np.minimum(d, .5) if correct else d) ** 2 / e).sum()


def test_chi_square(spark):
    df, y, x, z, c = table(spark)
    df = df.withColumn("b", (F.col("z") == 2).cast("int"))
    got = {r["test"]: r for r in A.chi_square(df, ["z", "b"], "y").collect()}
    tz = np.array([[((z == i) & (y == j)).sum() for j in (0, 1)] for i in (0, 1, 2)])
    tb = np.array([[(((z == 2) == i) & (y == j)).sum() for j in (0, 1)] for i in (0, 1)])
    assert got["chi2: z"]["statistic"] == pytest.approx(chi(tz, False)) and got["chi2: z"]["dof"] == 2
    assert got["chi2: b"]["statistic"] == pytest.approx(chi(tb, True))
    assert got["chi2: b"]["effect_size"] == pytest.approx(math.sqrt(chi(tb, False) / 400))


def test_empty_cell_counts_as_zero(spark):
    df = spark.createDataFrame([(0, "a")] * 5 + [(1, "b")] * 4 + [(0, "b")], "y int, f string")
    t = np.array([[5, 0], [1, 4]])
    assert A.chi_square(df, ["f"], "y").first()["statistic"] == pytest.approx(chi(t, True))


@pytest.mark.parametrize("kw", [{}, {"ranges": 9}])
def test_mann_whitney(spark, kw):
    df, y, x, z, c = table(spark)
    got = {r["test"]: r for r in A.mann_whitney(df, ["x", "c"], "y", **kw).collect()}
    for name, v in (("x", x), ("c", c)):
        u = sum((a > b) + .5 * (a == b) for a in v[y == 1] for b in v[y == 0])
        n1, n0 = (y == 1).sum(), (y == 0).sum()
        r = got[f"mannwhitneyu: {name}"]
        assert r["statistic"] == pytest.approx(u) and r["effect_size"] == pytest.approx(abs(1 - 2 * u / n1 / n0))
        t = np.unique(v, return_counts=True)[1].astype(float)
        n = n1 + n0
        sd = math.sqrt(n1 * n0 / 12 * (n + 1 - (t ** 3 - t).sum() / (n * (n - 1))))
        assert r["z"] == pytest.approx((max(u, n1 * n0 - u) - n1 * n0 / 2 - .5) / sd)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(9, None)], "i int, p_value double")
    got = {r["i"]: r["p_adj"] for r in A.adjust_fdr(df).collect()}
    assert [round(got[i], 6) for i in range(5)] == [0.025, 0.05, 0.05, 0.025, 0.9] and got[9] is None


def test_family_is_adjusted_together(spark):
    df, *_ = table(spark)
    rows = A.test_family(df, ["z"], ["x", "c"], "y").collect()
    assert len(rows) == 3 and [r["effect_size"] for r in rows] == sorted((r["effect_size"] for r in rows), reverse=True)
    assert all(0 <= r["p_value"] <= r["p_adj"] <= 1 for r in rows)


def newton(X, y):
    b = np.zeros(X.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        H = (X * (p * (1 - p))[:, None]).T @ X
        b = b + np.linalg.solve(H, X.T @ (y - p))
    p = 1 / (1 + np.exp(-X @ b))
    return b, np.sqrt(np.diag(np.linalg.inv(H))), (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


def test_logit_matches_newton(spark):
    df, y, x, z, c = table(spark)
    fit = R.fit_logit(df, "y", ["x", "z"], ["z"])
    b, se, ll = newton(np.column_stack([np.ones(400), x, z == 1, z == 2]), y)
    assert fit.terms == ["const", "x", "z_1", "z_2"] and fit.df_model == 3
    assert np.allclose(fit.coef, b, atol=1e-6) and np.allclose(fit.se, se, rtol=1e-4) and fit.loglik == pytest.approx(ll)
    m = y.mean()
    assert fit.null_loglik == pytest.approx(400 * (m * math.log(m) + (1 - m) * math.log(1 - m)))
    r = {q["term"]: q for q in R.odds_table(spark, [fit]).collect()}["x"]
    assert r["odds_ratio"] == pytest.approx(math.exp(b[1]), rel=1e-5) and r["ci_low"] < r["odds_ratio"] < r["ci_high"]


def test_calibration_line(spark):
    df, y, x, z, c = table(spark)
    p = 1 / (1 + np.exp(-(0.7 * x - 0.5)))
    scored = df.withColumn("p", 1 / (1 + F.exp(-(0.7 * F.col("x") - 0.5))))
    r = R.calibration_line(scored, "y", ["p"]).first()
    b, *_ = newton(np.column_stack([np.ones(400), np.log(p / (1 - p))]), y)
    assert r["calibration_intercept"] == pytest.approx(b[0], abs=1e-6) and r["calibration_slope"] == pytest.approx(b[1], abs=1e-6)


def test_nested_blocks(spark):
    df, *_ = table(spark)
    r = R.nested_table(df, "y", {"base": ["c"], "more": ["x"], "rest": ["z"]}, ["z"]).collect()
    assert [(q["comparison"], q["df"]) for q in r] == [("more", 1), ("rest", 2)] and r[0]["p_value"] < 1e-4


def test_design_blocks_have_all_predictors():
    assert len(S.FEATURES) == 19 == len(set(S.FEATURES))
    assert set(S.BINARY + S.NUMERIC + S.CATEGORICAL) == set(S.FEATURES)


def test_vif_and_spearman(spark):
    df, y, x, z, c = table(spark)
    df = df.withColumn("w", F.col("x") + 0.5 * F.col("c"))
    M = np.column_stack([x, x + 0.5 * c + 1e-9 * y, c])
    df3 = df.withColumn("w", F.col("w") + 0.3 * F.col("z"))
    got = {r["feature"]: r for r in correlation.variance_inflation(df3, ["x", "w", "c"]).collect()}
    M[:, 1] = x + 0.5 * c + 0.3 * z
    for j, name in enumerate(["x", "w", "c"]):
        o = np.column_stack([np.ones(400), np.delete(M, j, 1)])
        res = M[:, j] - o @ np.linalg.lstsq(o, M[:, j], rcond=None)[0]
        assert got[name]["vif"] == pytest.approx(M[:, j].var() / res.var(), rel=1e-6)
    assert got["x"]["flag"] == "severe"
    with pytest.raises(ValueError, match="combination"):
        correlation.variance_inflation(df, ["x", "w", "c"])

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    want = np.corrcoef(ranks(x), ranks(c))[0, 1]
    for kw in ({}, {"ranges": 7}, {"carried": 0}):
        assert correlation.spearman(df, ["x", "c"], **kw).first()["rho"] == pytest.approx(want)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # the same joins, shuffled
    try:
        assert correlation.spearman(df, ["x", "c"]).first()["rho"] == pytest.approx(want)
    finally:
        spark.conf.set(threshold, before)


def test_rank_agreement_with_ties(spark):
    df = spark.createDataFrame([("a", "p", 3.0), ("b", "p", 3.0), ("c", "p", 1.0), ("a", "q", 9.0), ("b", "q", 5.0), ("c", "q", 1.0)],
                               "i string, g string, m double")
    r = profile.rank_agreement(df, "i", "g", "m", ["p", "q"]).first()
    assert r["spearman_rank_correlation"] == pytest.approx(np.corrcoef([2.5, 2.5, 1], [3, 2, 1])[0, 1])


def test_count_models(spark):
    rng = np.random.default_rng(2)
    x = rng.negative_binomial(3, 0.4, 500)
    df = spark.createDataFrame([(int(v),) for v in x], "x int")
    r = distributions.poisson_vs_negbin(df, "x").first()
    m, v = x.mean(), x.var(ddof=1)
    k = m * m / (v - m)
    lp = sum(a * math.log(m) - m - math.lgamma(a + 1) for a in x)
    lb = sum(math.lgamma(a + k) - math.lgamma(k) - math.lgamma(a + 1) + k * math.log(k / (k + m)) + a * math.log(m / (k + m)) for a in x)
    assert r["loglik_poisson"] == pytest.approx(lp) and r["loglik_negbin"] == pytest.approx(lb)
    assert r["p_value"] == pytest.approx(0.5 * chi2_sf(2 * (lb - lp), 1), abs=1e-12)


def test_continuous_fits(spark):
    rng = np.random.default_rng(4)
    x = rng.gamma(2.5, 3.0, 800)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r["distribution"]: r for r in distributions.continuous_fits(df, "x").collect()}
    assert min(got.values(), key=lambda r: r["aic"])["distribution"] == "gamma" and got["gamma"]["delta_aic"] == 0
    assert got["gamma"]["ks_stat"] < 0.06 < got["normal"]["ks_stat"]
    n, m, s = len(x), x.mean(), x.std()
    assert got["normal"]["loglik"] == pytest.approx(-n / 2 * (math.log(2 * math.pi * s * s) + 1))

    # no neighbouring parameter does better than the fitted ones
    def weibull(k, l):
        return (np.log(k / l) + (k - 1) * np.log(x / l) - (x / l) ** k).sum()

    def gamma(a, t):
        return ((a - 1) * np.log(x) - x / t - a * math.log(t) - math.lgamma(a)).sum()
    ks = np.linspace(1.2, 2.2, 401)
    best = max(weibull(k, (x ** k).mean() ** (1 / k)) for k in ks)
    assert best - 1e-9 <= got["weibull"]["loglik"] < best + 0.02
    best = max(gamma(a, m / a) for a in np.linspace(1.5, 4, 801))
    assert best - 1e-9 <= got["gamma"]["loglik"] < best + 0.02
