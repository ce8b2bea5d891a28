"""Folds, encoders, out-of-fold scores, importance, anomaly and clusters."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import anomaly, clusters, encode, folds, importance, oof, phenotypes, quality, wide_encode


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 400
    x, w, u = rng.normal(size=n), rng.normal(size=n), rng.poisson(1.5, n)
    g = rng.choice(["a", "b", "c"], n, p=[.6, .37, .03])
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x + (g == "b") - 1)))).astype(int)
    df = spark.createDataFrame(
        [(i, int(a), float(b), float(c), int(d), str(e)) for i, (a, b, c, d, e) in enumerate(zip(y, x, w, u, g))],
        "k long, y int, x double, w double, u int, g string")
    return folds.group_folds(df, "k", ["y"]).persist()


def test_group_folds(spark):
    df = spark.createDataFrame([(e, i, (e + i) % 2) for e in range(30) for i in range(2)], "e int, i int, y int")
    out = folds.group_folds(df, "e", ["y"])
    assert out.count() == 60 and quality.split_entities(out, "e", "fold").isEmpty()
    per = out.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert len(per) == 5 and {r["n"] for r in per} == {12} and {r["p"] for r in per} == {6}
    want = {tuple(r) for r in out.select("e", "i", "fold").collect()}
    for n in (1, 7):
        again = folds.group_folds(df.repartition(n, "i"), "e", ["y"])
        assert {tuple(r) for r in again.select("e", "i", "fold").collect()} == want
    cut = folds.group_folds(df, "e", ["y"], ranges=6)
    assert {tuple(r) for r in cut.select("e", "i", "fold").collect()} == want


def test_samples_do_not_depend_on_partitioning(rows):
    a = {r["k"] for r in folds.hash_sample(rows, "k", 50).collect()}
    assert len(a) == 50 and a == {r["k"] for r in folds.hash_sample(rows.repartition(7), "k", 50).collect()}


def test_encoder(rows):
    enc = encode.FeatureEncoder(["x"], ["u"], ["g"], min_count=50).fit(rows)
    assert list(enc.columns()) == ["num__x", "bin__u", "cat__g_a", "cat__g_b", f"cat__g_{encode.RARE}"]
    new = rows.limit(1).withColumn("g", F.lit("zzz"))
    assert vector_of(enc, new)[2:] == [0, 0, 1]
    assert vector_of(enc, new.withColumn("g", F.lit("b")))[2:] == [0, 1, 0]
    z = enc.transform(rows).select(vector_to_array("features")[0].alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(z[0]) < 1e-9 and z[1] == pytest.approx(1)
    some = rows.withColumn("g", F.when(F.col("k") % 2 == 0, F.col("g")))
    gaps = encode.FeatureEncoder([], [], ["g"]).fit(some)
    assert list(gaps.columns())[0] == f"cat__g_{encode.MISSING}" and vector_of(gaps, some.where("k = 1"))[0] == 1
    drop = encode.FeatureEncoder([], [], ["g"], drop_first=True).fit(rows)
    assert list(drop.columns()) == ["cat__g_b", "cat__g_c"] and vector_of(drop, new) == [0, 0]


def vector_of(model, df):
    return list(model.transform(df).select(vector_to_array("features")).first()[0])


def test_wide_encoder_equals_the_plain_one(rows):
    some = rows.withColumn("h", F.when(F.col("k") % 7 > 0, (F.col("k") % 7).cast("string")))
    for min_count in (1, 50):
        plain = encode.FeatureEncoder(["x"], ["u"], ["g", "h"], min_count=min_count).fit(some)
        wide = wide_encode.WideEncoder(["x"], ["u"], ["g", "h"], min_count=min_count).fit(some)
        assert wide.width() == len(plain.columns())
        new = some.withColumn("g", F.when(F.col("k") % 9 == 0, "never seen").otherwise(F.col("g")))
        a, b = (m.transform(new).select("k", vector_to_array("features").alias("v")).toPandas().sort_values("k")["v"].tolist() for m in (plain, wide))
        assert np.allclose(np.array(a), np.array(b))
    empty = wide_encode.WideEncoder(["x"], [], ["g"]).fit(some.limit(0))
    assert vector_of(empty, some.where("k = 1")) == vector_of(empty, some.where("k = 1")) and empty.width() == 1


def test_wide_encoder_takes_a_million_levels(spark):
    df = spark.range(1_000_000).select(F.col("id").cast("string").alias("c"), (F.col("id") % 3).cast("double").alias("b"))
    model = wide_encode.WideEncoder([], ["b"], ["c"]).fit(df)
    assert model.width() == 1_000_001
    seen = model.transform(df.where("c IN ('0', '42', '999999')").unionByName(spark.createDataFrame([("new", 1.0)], "c string, b double"))).collect()
    assert all(r["features"].size == 1_000_001 and type(r["features"]).__name__ == "SparseVector" for r in seen)
    places = {r["c"]: [int(i) for i in r["features"].indices if i] for r in seen}
    assert places["new"] == [] and len({p[0] for c, p in places.items() if c != "new"}) == 3


def prep():
    return [encode.FeatureEncoder(["x", "w"], [], ["g"])]


def test_out_of_fold(rows):
    models = {"lr": lambda n, pos: [oof.logistic("y", n)],
              "svm": oof.linear_svm(), "trees": oof.boosted_trees(rounds=20)}
    out = oof.out_of_fold(rows, "fold", "y", "k", prep, models).toPandas()
    assert sorted(out["k"]) == list(range(400)) and out["lr"].between(0, 1).all()
    corr = np.corrcoef(out["lr"].rank(), out["svm"].rank())[0, 1]
    assert list(out.columns) == ["k", "y", "fold", "lr", "svm", "trees"] and np.corrcoef(out["lr"].rank(), out["trees"].rank())[0, 1] > 0.8
    assert corr > 0.9 and out.loc[out.y == 1, "lr"].mean() > out.loc[out.y == 0, "lr"].mean() + 0.1
    # the held-out fold really is scored by the model of the other folds
    one = Pipeline(stages=[*prep(), oof.logistic("y", rows.where("fold <> 0").count())]).fit(rows.where("fold <> 0"))
    direct = one.transform(rows.where("fold = 0")).select("k", oof.score_of(one.transform(rows)).alias("p")).toPandas()
    both = direct.merge(out, on="k")
    assert np.allclose(both["p"], both["lr"], atol=1e-6)
    with pytest.raises(ValueError, match="held-out"):
        oof.out_of_fold(rows.union(rows.withColumn("fold", (F.col("fold") + 1) % 5)), "fold", "y", "k", prep, models)


def test_perceptron_reads_its_width(rows):
    model = Pipeline(stages=[*prep(), oof.perceptron("y", 5)]).fit(rows)
    assert model.transform(rows).select("probability").count() == 400


def test_permutation_importance(spark, rows):
    two = rows.withColumn("z", 1 - F.col("y"))
    held, groups, models = oof.logistic_folds(two, "fold", ["y", "z"], "k", lambda: prep()[0])
    assert held.count() == 400 and groups[0] == {"x": [0], "w": [1], "g": [2, 3, 4]}
    drops = importance.permutation_importance(held, "fold", ["y", "z"], "k", groups, models)
    assert drops.count() == 2 * 5 * 3 * 3
    out = {(r["label"], r["feature"]): r for r in importance.importance_summary(drops, ["label"]).collect()}
    for label in ("y", "z"):
        assert out[label, "x"]["rank"] == 1 and out[label, "x"]["mean_ap_decrease"] > 5 * abs(out[label, "w"]["mean_ap_decrease"])
    again = importance.permutation_importance(held.repartition(7), "fold", ["y", "z"], "k", groups, models)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drops.collect()))


def test_permutation_pass_scores_like_shuffled_rows(spark, rows):
    """One fold, one block: the drop follows from shuffling the column by the same draw."""
    held, groups, models = oof.logistic_folds(rows, "fold", ["y"], "k", lambda: prep()[0])
    pdf = held.where("fold = 2").withColumn("h", folds.key_hash("k", 43)).toPandas().sort_values(["h", "k"])
    x, y = np.stack(pdf["features"]), pdf["y"].to_numpy()

    def ap(score):
        order = np.argsort(-score, kind="stable")
        hits = y[order]
        return (np.cumsum(hits) / np.arange(1, len(y) + 1))[hits == 1].mean()

    got = {(r.feature, r.repeat): r.ap_decrease for r in importance.permutation_importance(held, "fold", ["y"], "k", groups, models).where("fold = 2").collect()}
    for i, feature in enumerate(sorted(groups[2]), 1):
        for repeat in range(3):
            donor = np.random.default_rng([42, 2, 0, i, repeat]).permutation(len(x))
            moved = x.copy()
            moved[:, groups[2][feature]] = x[donor][:, groups[2][feature]]
            assert got[feature, repeat] == pytest.approx(ap(models["y", 2](x)) - ap(models["y", 2](moved)))
    parts = importance.permutation_importance(held, "fold", ["y"], "k", groups, models, block_rows=20)
    assert parts.count() == 45


def test_signed_sum_before_magnitude(spark):
    rows = [(1, "cat__gender_M", .3), (1, "cat__gender_F", -.2), (1, "num__age", -.4),
            (2, "cat__gender_M", -.1), (2, "cat__gender_F", .1), (2, "num__age", .2)]
    df = spark.createDataFrame(rows, "k int, encoded_feature string, phi double")
    got = {r["source_feature"]: r for r in importance.source_importance(df, "k", ["gender"]).collect()}
    assert got["gender"]["mean_abs_shap"] == pytest.approx(0.05) and got["age"]["mean_abs_shap"] == pytest.approx(0.3)
    zero = importance.source_importance(df.withColumn("phi", F.lit(0.0)), "k", ["gender"]).collect()
    assert all(r["importance_pct"] == 0 for r in zero)


def test_anomalies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 2))
    x[:6] += 9
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    out = anomaly.anomaly_flags(df, ["a", "b"], "k", trees=50).toPandas()
    assert set(out.loc[out.is_anomaly, "k"]) <= set(range(6)) | set(out.nlargest(6, "anomaly_score")["k"])
    assert len(set(out.nlargest(6, "anomaly_score")["k"]) & set(range(6))) >= 5
    assert 1 <= out["is_anomaly"].sum() <= 6
    again = anomaly.anomaly_flags(df.repartition(7), ["a", "b"], "k", trees=50).toPandas()
    assert np.allclose(out.sort_values("k")["anomaly_score"], again.sort_values("k")["anomaly_score"])


def test_large_input_pool_fills_every_tree(spark):
    df = spark.range(20000).withColumn("a", F.rand(1))
    s = anomaly.tree_samples(df, ["a"], "id", trees=8, sample=64, seed=1, n=20000)
    assert {r["count"] for r in s.groupBy("tree").count().collect()} == {64}


def test_clusters_against_plain_numpy(spark):
    rng = np.random.default_rng(11)
    centres = np.array([[0, 0], [40, 5], [5, 60]])
    x = np.abs(np.vstack([c + rng.normal(size=(40, 2)) for c in centres]))
    df = spark.createDataFrame([(i, int(i % 4 == 0), float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, y int, a double, b double")
    vec = phenotypes.standardized_logs(df, ["a", "b"]).withColumn("features", vector_to_array("features"))
    models = clusters.fit_clusters(vec, "k", [2, 3, 4], restarts=4)
    assert len(models) == 12
    pdf = vec.toPandas()
    v = np.stack(pdf["features"])
    for m in models[::3]:
        far = ((v[:, None] - m.centres) ** 2).sum(2)
        c = far.argmin(1)
        assert m.cost == pytest.approx(far.min(1).sum())
        for j in set(c):  # a fixed point
            assert np.allclose(v[c == j].mean(0), m.centres[j], atol=1e-3)
        d = ((v[:, None] - v[None]) ** 2).sum(2)
        s = []
        for i in range(len(v)):
            if (c == c[i]).sum() == 1:
                s.append(0.0)
                continue
            a = d[i, (c == c[i]) & (np.arange(len(v)) != i)].mean()
            b = min(d[i, c == g].mean() for g in set(c) - {c[i]})
            s.append((b - a) / max(a, b))
        assert m.silhouette == pytest.approx(np.mean(s))
    three = clusters.best(models, 3)
    got = clusters.assign(vec, three).toPandas()["cluster"].to_numpy()
    assert sorted(np.bincount(got)) == [40, 40, 40]
    selection, assigned, profiles = phenotypes.phenotypes(df, "k", "y", ["a", "b"], ks=(2, 3), restarts=2)
    assert selection.count() == 2 and assigned.count() == 120 and selection.orderBy(F.desc("silhouette")).first()["k"] == 3
    assert profiles.count() == 3 and profiles.agg(F.sum("n")).first()[0] == 120 and profiles.first()["seed_stability_ari"] == 1
    assert clusters.fit_clusters(vec.limit(0), "k", [2]) == []


def test_forest_walk_equals_the_scores(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)).round(1))], "k long, a double, b double")
    model = anomaly.IsolationForest(["a", "b"], "k", trees=20, sample=64).fit(df)
    both = model.transform(df).withColumnRenamed("anomaly_score", "s").join(anomaly.walked_scores(df, "k", model), "k").toPandas()
    assert len(both) == 300 and np.allclose(both["s"], both["anomaly_score"])


def test_folds_keep_rows_without_entity(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), (1, 1), (2, 0)], "e int, y int")
    got = folds.group_folds(df, "e", ["y"]).collect()
    assert len(got) == 4 and len({r.fold for r in got if r.e is None}) == 1
