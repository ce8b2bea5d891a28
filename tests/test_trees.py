"""Boosted trees, their Shapley values and the linear plane against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import boosting, importance, linear, tree_shap

N = 300


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=N).round(2), rng.integers(0, 2, N), rng.integers(0, 4, N), rng.normal(size=N).round(1)])
    x[::17, 3] = np.nan
    y = (rng.random(N) < 1 / (1 + np.exp(-(x[:, 0] + x[:, 1] * (x[:, 2] - 1))))).astype(int)
    return x, y


def table(spark, x, y, models=("a", "b"), parts=3):
    rows = [(m, i, int(y[i]), bool(m == "a" or i % 3), [None if math.isnan(v) else float(v) for v in x[i]]) for m in models for i in range(len(y))]
    return spark.createDataFrame(rows, "model string, k long, label int, train boolean, features array<double>").repartition(parts)


def plain_boost(x, y, train, s):
    """Level by level over sorted distinct values; every row, every column."""
    x = np.where(np.isnan(x), np.nanmin(x[train], 0), x)
    p0 = y[train].mean()
    margin = np.full(len(y), np.log(p0 / (1 - p0)))
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(inside, depth):
            rows = inside & train
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if depth:
                for f in range(x.shape[1]):
                    for cut in np.unique(x[train, f])[1:]:
                        left, right = rows & (x[:, f] < cut), rows & (x[:, f] >= cut)
                        hl, hr = h[left].sum(), h[right].sum()
                        if hl < s.least_weight or hr < s.least_weight:
                            continue
                        gain = (g[left].sum() ** 2 / (hl + s.l2) + g[right].sum() ** 2 / (hr + s.l2) - G**2 / (H + s.l2)) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
            if best[1] is None:
                margin[inside] += -s.rate * G / (H + s.l2)
            else:
                f, cut = best[1]
                grow(inside & (x[:, f] < cut), depth - 1)
                grow(inside & (x[:, f] >= cut), depth - 1)

        grow(np.ones(len(y), bool), s.depth)
    return margin


def test_boosting_equals_plain_boosting(spark, data, monkeypatch):
    monkeypatch.setattr(boosting, "FLUSH", 3)
    monkeypatch.setattr(boosting, "BLOCK", 20)
    x, y = data
    s = boosting.Settings(rounds=8, depth=3, rate=0.3, rows=1.0, columns=1.0, least_weight=2.0)
    models, scored = boosting.fit_boosted(table(spark, x, y), "k", s)
    got = scored.toPandas()
    for name, train in (("a", np.ones(N, bool)), ("b", np.arange(N) % 3 > 0)):
        mine = got[got.model == name].sort_values("k")
        assert np.allclose(mine["margin"], plain_boost(x, y, train, s))
        assert np.allclose(mine["score"], 1 / (1 + np.exp(-mine["margin"]))) and (mine["train"].to_numpy() == train).all()
    nodes = boosting.node_table(spark, models)
    assert nodes.where("low IS NULL AND value IS NULL").isEmpty() and nodes.select("model", "tree").distinct().count() == 16


@pytest.mark.parametrize("alone", [0, 250, 1 << 16])
def test_models_of_few_rows_grow_without_a_job_for_each_level(spark, data, monkeypatch, alone):
    """All models over blocks, one of two, or none: the same trees, and jobs that do not go with the rounds."""
    x, y = data
    s = boosting.Settings(rounds=12, rows=0.7, columns=0.5, least_weight=1.0)
    monkeypatch.setattr(boosting, "ALONE", 0)
    expected, _ = boosting.fit_boosted(table(spark, x, y), "k", s)
    monkeypatch.setattr(boosting, "ALONE", alone)
    passes = []
    monkeypatch.setattr(boosting, "_level_sums", lambda *a, sums=boosting._level_sums: passes.append(1) or sums(*a))
    got, _ = boosting.fit_boosted(table(spark, x, y), "k", s)
    assert bool(passes) == (alone < 1 << 16)
    for name, model in expected.items():
        assert len(got[name].trees) == len(model.trees) == 12
        for a, b in zip(got[name].trees, model.trees):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value, rtol=0, atol=1e-9)


def test_boosting_does_not_depend_on_partitions_and_samples_rows_and_columns(spark, data):
    x, y = data
    s = boosting.Settings(rounds=12, rows=0.7, columns=0.5, least_weight=1.0)
    a, b = (boosting.fit_boosted(table(spark, x, y, parts=p), "k", s)[1].toPandas().sort_values(["model", "k"]) for p in (1, 6))
    assert np.allclose(a["margin"], b["margin"])
    full = boosting.fit_boosted(table(spark, x, y), "k", boosting.Settings(rounds=12, rows=1.0, columns=1.0, least_weight=1.0))[1].toPandas().sort_values(["model", "k"])
    assert not np.allclose(a["margin"], full["margin"])
    u = np.arange(100_000, dtype=np.int64)
    share = boosting._mixed(u, 4)
    assert abs((share < 0.8).mean() - 0.8) < 0.01 and abs(np.corrcoef(share, boosting._mixed(u, 5))[0, 1]) < 0.01


def test_boosting_of_nothing_and_of_one_class(spark, data):
    x, y = data
    models, scored = boosting.fit_boosted(table(spark, x, y).limit(0), "k")
    assert models == {} and scored.count() == 0 and scored.columns == ["model", "k", "label", "train", "margin", "score"]
    models, scored = boosting.fit_boosted(table(spark, x[:40], np.ones(40, int)), "k", boosting.Settings(rounds=3))
    assert scored.agg(F.min("score")).first()[0] > 0.99


def coalition_values(model, row, background, probability):
    """Shapley values by all subsets of features."""
    d = len(row)

    def score(values):
        m = model.base + boosting.margins(model.trees, model.bins_of(values))
        return boosting.sigmoid(m) if probability else m

    phi = np.zeros((len(background), d))
    for j, z in enumerate(background):
        value = {}
        for subset in itertools.product([0, 1], repeat=d):
            value[subset] = float((model.base + boosting.margins(model.trees, model.bins_of(np.where(subset, row, z)[None])))[0])
        for i in range(d):
            for subset, v in value.items():
                if not subset[i]:
                    k = sum(subset)
                    on = tuple(1 if c == i else b for c, b in enumerate(subset))
                    phi[j, i] += math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * (value[on] - v)
        if probability:
            mx, mz = value[(1,) * d], value[(0,) * d]
            px, pz = boosting.sigmoid(np.array([mx, mz]))
            phi[j] *= px * (1 - px) if abs(mx - mz) < 1e-9 else (px - pz) / (mx - mz)
    return phi.mean(0)


@pytest.mark.parametrize("probability", [True, False])
def test_shapley_values_equal_all_coalitions(spark, data, probability, monkeypatch):
    monkeypatch.setattr(tree_shap, "MASKS", 8)
    x, y = data
    rows = table(spark, x, y, models=("a",))
    models, _ = boosting.fit_boosted(rows, "k", boosting.Settings(rounds=6, depth=4, rate=0.4, least_weight=1.0))
    background = x[[3, 17, 40, 41, 99, 120, 200]]
    got = tree_shap.tree_contributions(rows, "k", models["a"], background, probability).toPandas().sort_values("k")
    phi = np.stack(got["phi"])
    assert len(got) == N and np.allclose(got["base"] + phi.sum(1), got["p"], atol=1e-12)
    for i in (0, 17, 40, 101):
        assert np.allclose(phi[i], coalition_values(models["a"], x[i], background, probability), atol=1e-12)


def test_contributions_are_written_as_arrays(spark, data, tmp_path):
    x, y = data
    rows = table(spark, x, y, models=("a",))
    models, scored = boosting.fit_boosted(rows, "k", boosting.Settings(rounds=10, least_weight=1.0))
    phi = importance.shapley_contributions(rows, "k", models["a"], background=20)
    assert importance.additivity_error(phi).first()[0] < 1e-9
    assert phi.join(scored, "k").agg(F.max(F.abs(F.col("p") - F.col("score")))).first()[0] < 1e-12
    importance.write_contributions(phi, ["num__x", "bin__b", "cat__g_1", "cat__g_2"], str(tmp_path / "phi"))
    back = importance.read_contributions(spark, str(tmp_path / "phi"), "k")
    assert back.count() == 4 * N
    top = importance.source_importance(back, "k", ["g"]).collect()
    assert {r["source_feature"] for r in top} == {"x", "b", "g"} and sum(r["importance_pct"] for r in top) == pytest.approx(100)


def test_planes_are_optimal(spark, data):
    x, y = data
    planes = linear.fit_planes(table(spark, x, y), linear.Settings(c=0.7))
    for name, train in (("a", np.ones(N, bool)), ("b", np.arange(N) % 3 > 0)):
        z = np.column_stack([np.nan_to_num(x[train]), np.ones(train.sum())])
        s, w = 2 * y[train] - 1, planes[name]
        share = 0.7 * np.where(y[train] == 1, train.sum() / (2 * y[train].sum()), train.sum() / (2 * (1 - y[train]).sum()))
        slack = np.maximum(0, 1 - s * (z @ w))
        assert np.abs(w - 2 * z.T @ (share * s * slack)).max() < 1e-5 and np.abs(w).max() > 0.1
    assert linear.fit_planes(table(spark, x, y).limit(0)) == {}
    margins = linear.plane_margins(table(spark, x, y), "k", planes).toPandas()
    assert len(margins) == 2 * N and margins["margin"].notna().all()


def test_curvature_is_the_derivative_of_the_gradient():
    rng = np.random.default_rng(0)
    block = linear._Block("a", rng.normal(size=(50, 4)), rng.choice([-1.0, 1.0], 50), rng.random(50))
    w, d = rng.normal(size=4), rng.normal(size=4)
    step = 1e-6
    numeric = (linear._loss(block, w + step * d)[1:] - linear._loss(block, w - step * d)[1:]) / (2 * step)
    assert np.allclose(linear._curvature(block, w, d), numeric, rtol=1e-4, atol=1e-5)
