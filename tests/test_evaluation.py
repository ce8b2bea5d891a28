"""Score audit arithmetic on hand-checked inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.rates import wilson
from cohortlens.operators import evaluation as V, phenotypes, resample


def brute_ap(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    tp = fp = ap = 0.0
    for v in sorted(set(s), reverse=True):
        at = s == v
        gain = (w * y)[at].sum()
        tp, fp = tp + gain, fp + (w * (1 - y))[at].sum()
        ap += gain * tp / (tp + fp) if tp + fp else 0
    return ap / (w * y).sum()


def test_average_precision_and_auc(spark):
    df = spark.createDataFrame(
        list(zip([1, 0, 1, 0, 1, 0], [.9, .8, .7, .6, .5, .5])), "y int, s double")
    r = V.rank_metrics(V.long_scores(df, "y", ["s"]), "y", ["model"]).first()
    assert r["pr_auc"] == pytest.approx(0.722222, abs=1e-6)
    assert r["roc_auc"] == pytest.approx((3 + 2 + 0.5) / 9)
    assert r["lift"] == pytest.approx(r["pr_auc"] / 0.5)


@pytest.mark.parametrize("kw", [{}, {"ranges": 8}])
def test_rank_metrics_against_brute_force(spark, kw):
    rng = np.random.default_rng(1)
    y, s, t = rng.integers(0, 2, 300), rng.random(300), rng.integers(0, 4, 300).astype(float)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, s, t)], "y int, s double, t double")
    got = {r["model"]: r for r in V.rank_metrics(V.long_scores(df, "y", ["s", "t"]), "y", ["model"], **kw).collect()}
    for name, v in (("s", s), ("t", t)):
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in v[y == 1] for b in v[y == 0]])
        assert got[name]["pr_auc"] == pytest.approx(brute_ap(y, v)) and got[name]["roc_auc"] == pytest.approx(auc)


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 20), (20, 20), (3, 10)], "k int, n int")
    p, lo, hi = wilson(F.col("k"), F.col("n"))
    r = [tuple(x) for x in df.select(p, lo, hi).collect()]
    assert r[0] == (None, None, None)
    assert r[1][:2] == (0.0, 0.0) and r[1][2] > 0
    assert r[2][2] == 1.0 and r[2][1] < 1
    assert r[3][1] == pytest.approx(0.1077913, abs=1e-6) and r[3][2] == pytest.approx(0.6032219, abs=1e-6)


AUDIT = "k int, y int, p double, race string, gender string"
ROWS = [(1, 1, .7, "A", "F"), (2, 1, .1, "A", "M"), (3, 0, .8, "A", "F"), (4, 0, .2, "A", None), (5, 0, .1, "A", "F")]


def test_subgroup_audit(spark):
    df = spark.createDataFrame(ROWS, AUDIT)
    r = V.subgroup_audit(df, "y", "p", ["race", "gender"], [0.5]).where("attribute = 'race'").first()
    assert (r["tpr"], r["tp"], r["fp"]) == (0.5, 1, 1) and r["fpr"] == pytest.approx(1 / 3)
    assert r["tpr_ci_low"] < 0.5 < r["tpr_ci_high"] and r["small_event_count"]
    groups = V.subgroup_audit(df, "y", "p", ["gender"], [0.5])
    assert {x["group"] for x in groups.collect()} == {"F", "M", "Missing"}


def test_check_scored(spark):
    df = spark.createDataFrame(ROWS, AUDIT)
    V.check_scored(df, "k", "y", "p", ["race"])
    with pytest.raises(ValueError, match="one row per"):
        V.check_scored(df.union(df), "k", "y", "p", ["race"])
    with pytest.raises(ValueError, match="age_band"):
        V.check_scored(df, "k", "y", "p", ["age_band"])


def test_gap_ignores_tiny_groups(spark):
    cols = "attribute string, threshold double, group string, events int, non_events int, tpr double, fpr double"
    df = spark.createDataFrame(
        [("a", .1, "x", 50, 50, .5, .2), ("a", .1, "y", 40, 50, .6, .2), ("a", .1, "z", 1, 5, 1.0, .9)], cols)
    got = {r["metric"]: r for r in V.gap_table(df).collect()}
    assert got["tpr"]["max_minus_min"] == pytest.approx(0.1) and got["tpr"]["eligible_groups"] == 2
    assert (got["tpr"]["highest_group"], got["tpr"]["lowest_group"]) == ("y", "x")
    assert got["fpr"]["max_minus_min"] == 0 and got["fpr"]["highest_group"] == "x"
    one = V.gap_table(df.where("group = 'x'")).where("metric = 'tpr'").first()
    assert one["max_minus_min"] is None and one["highest_group"] is None


def test_two_bin_calibration(spark):
    p = [.05, .10, .15, .20, .25, .30, .35, .40]
    df = spark.createDataFrame(list(zip([0, 0, 1, 0, 0, 1, 1, 1], p)), "y int, m double")
    r = V.reliability_bins(df, "y", ["m"], bins=2).orderBy("bin").collect()
    assert [round(x["mean_predicted_probability"], 6) for x in r] == [0.125, 0.325]
    assert [x["observed_event_rate"] for x in r] == [0.25, 0.75]


def test_thresholds_and_zero_division(spark):
    df = spark.createDataFrame([(0, .2), (1, .3), (0, .1)], "y int, p double")
    assert V.THRESHOLDS == [0.05, 0.10, 0.15, 0.20, 0.25] and V.TOP_FRACTIONS == [0.05, 0.10, 0.20]
    r = {x["threshold"]: x for x in V.threshold_table(df, "y", "p", [0.15, 0.9, 0.0]).collect()}
    assert (r[0.15]["tp"], r[0.15]["fp"], r[0.15]["tn"], r[0.15]["fn"]) == (1, 1, 1, 0)
    assert r[0.9]["ppv_precision"] == 0 and r[0.9]["f1"] == 0 and r[0.9]["mcc"] == 0 and r[0.9]["npv"] == pytest.approx(2 / 3)
    assert r[0.0]["npv"] is None and r[0.0]["sensitivity_recall"] == 1


@pytest.mark.parametrize("kw", [{}, {"ranges": 11}])
def test_top_fraction_uses_higher_quantile(spark, kw):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(137), 2)
    df = spark.createDataFrame([(int(v > .5), float(v)) for v in p], "y int, p double")
    got = {r["rule"]: r for r in V.top_fraction_table(df, "y", "p", **kw).collect()}
    for f in V.TOP_FRACTIONS:
        cut = np.quantile(p, 1 - f, method="higher")
        r = got[f"top_{round(100 * f)}pct_risk"]
        assert r["threshold"] == cut and r["flagged_n"] == (p >= cut).sum()


def scored(spark, n=120):
    y = [0, 0, 0, 1] * (n // 4)
    s = np.linspace(.01, .9, n)
    return spark.createDataFrame([(i, y[i], float(s[i]), float(i % 3)) for i in range(n)], "k long, y int, a double, tied double")


def test_identical_scores_never_differ(spark):
    df = scored(spark).withColumn("b", F.col("a"))
    draws = resample.bootstrap_ap(df, "k", "y", ["a", "b"], draws=40)
    r = resample.paired_differences(draws, [("a", "b")]).first()
    assert (r["mean_diff"], r["ci_low"], r["ci_high"], r["excludes_zero"]) == (0, 0, 0, False)


@pytest.mark.parametrize("cells", [1, 3, 40, None])
def test_bootstrap_against_brute_force(spark, cells, monkeypatch):
    """Every cut into cells gives the weighted average precision of the same weights."""
    monkeypatch.setattr(resample, "CHUNK", 5)
    monkeypatch.setattr(resample, "STEP", 7)
    df = scored(spark).withColumns({"one": F.lit(0.5), "gaps": F.when(F.col("k") % 4 != 0, F.round("a", 1))})
    names = ["a", "tied", "one", "gaps"]
    got = {(r["model"], r["draw"]): r["pr_auc"] for r in resample.bootstrap_ap(df.repartition(5), "k", "y", names, draws=12, cells=cells).collect()}
    pdf = df.withColumn("h", F.xxhash64("k", F.lit(42))).toPandas()
    w = resample.poisson_weights(pdf["h"].to_numpy(), np.arange(12))
    assert 0.7 < w.mean() < 1.3
    for m in names:
        for d in range(12):
            assert got[m, d] == pytest.approx(brute_ap(pdf["y"].to_numpy(), pdf[m].fillna(-1).to_numpy(), w[:, d]))
    assert len(got) == 12 * len(names)


def test_bootstrap_without_events_or_rows(spark):
    df = scored(spark).withColumn("y", F.lit(0))
    assert {r["pr_auc"] for r in resample.bootstrap_ap(df, "k", "y", ["a"], draws=3).collect()} == {None}
    assert resample.bootstrap_ap(df.limit(0), "k", "y", ["a"], draws=3).count() == 0


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0), (1, 2)], "a int, b int")
    assert phenotypes.rand_index(df, "a", "a").first()[0] == 1
    # cells 2,2,1; rows 2,3; columns 2,2,1: (2 - 4*2/10) / ((4+2)/2 - 0.8)
    assert phenotypes.rand_index(df, "a", "b").first()[0] == pytest.approx(1.2 / 2.2)
