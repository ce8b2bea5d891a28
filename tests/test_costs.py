"""How often rows are read or weighted, and over how many tasks costly steps are dealt."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens.operators import anomaly, boosting, clusters, linear, ordered, regression, resample, tree_shap
from cohortlens.session import materialize


def one_partition(spark, n=20_000):
    rows = spark.range(n, numPartitions=1)
    return rows.select(F.lit("all").alias("model"), "id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(True).alias("train"),
                       F.array((F.col("id") % 7).cast("double"), (F.col("id") % 2).cast("double")).alias("features"))


def test_blocks_of_one_file_use_all_cores(spark):
    rows = one_partition(spark)
    models = boosting.find_cuts(rows, boosting.Settings())
    blocks = boosting._blocks(boosting._binned(rows, models, "id", boosting.Settings()), models)
    assert blocks.getNumPartitions() == min(20_000 // boosting.STEP, spark.sparkContext.defaultParallelism)
    assert sum(len(b.label) for b in blocks.collect()) == 20_000


def test_walking_together_equals_walking_one_by_one():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 9, (500, 4)).astype(np.uint8)
    trees = []
    for depth in (3, 3, 2, 3):
        tree = boosting.Tree.empty(depth)
        inner = len(tree.feature) // 2
        tree.feature[:inner], tree.cut[:inner] = rng.integers(-1, 4, inner), rng.integers(1, 9, inner)
        tree.value[:] = rng.normal(size=len(tree.value))
        trees.append(tree)
    alone = sum(t.value[t.places(bins, int(np.log2(len(t.value) + 1)) - 1)] for t in trees)
    assert np.allclose(boosting.margins(trees, bins), alone, rtol=0, atol=1e-12)


def test_planes_take_few_passes(spark, monkeypatch):
    rows = spark.range(2_000).select(
        F.lit("all").alias("model"), "id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(True).alias("train"),
        F.array(*[(F.rand(i) * (i + 1) + (F.col("id") % 3 == 0).cast("int")).alias("x") for i in range(12)]).alias("features")).localCheckpoint()
    passes, summed = [], linear._summed
    monkeypatch.setattr(linear, "_summed", lambda *a: passes.append(1) or summed(*a))
    solved = linear.fit_planes(rows)["all"]
    few = len(passes)
    monkeypatch.setattr(linear, "DENSE", 0)
    assert np.allclose(solved, linear.fit_planes(rows)["all"], atol=1e-6)
    assert few <= 25 and few < len(passes) - few


def test_rows_in_the_same_bins_are_explained_over_all_cores(spark):
    rows = one_partition(spark, 3_000)
    models, _ = boosting.fit_boosted(rows, "id", boosting.Settings(rounds=2, depth=2))
    phi = tree_shap.tree_contributions(rows, "id", models["all"], np.array([[0.0, 1.0], [3.0, 0.0]]))
    assert phi.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    explainer = tree_shap.Explainer(models["all"], np.array([[0.0, 1.0], [3.0, 0.0]]))
    for r in phi.where("id < 20").collect():
        p, values = explainer.explain(np.array([[r["id"] % 7, r["id"] % 2]], float))
        assert np.allclose(r["phi"], values[0]) and abs(r["p"] - p[0]) < 1e-12


def test_logit_reads_a_written_table(spark, monkeypatch):
    written = []
    monkeypatch.setattr(regression, "materialize", lambda df: written.append(1) or df)
    df = spark.range(400).select((F.col("id") % 5 < 2).cast("int").alias("y"), (F.col("id") % 4).cast("double").alias("x")).groupBy("x", "y").count()
    regression.fit_logit(df, "y", ["x"])
    assert written == [1]


def test_bootstrap_weights_a_row_once(monkeypatch):
    weighted, plain = [], resample.poisson_weights
    monkeypatch.setattr(resample, "poisson_weights", lambda h, d: weighted.append(len(h) * len(d)) or plain(h, d))
    h = np.arange(900, dtype=np.int64) * 0x9E3779B97F4A7C1
    for scores in ([1.0], [2.0, 1.0], [3.0, 2.0, 1.0]):
        weighted.clear()
        cell = pa.table({"model": ["m"] * 900, "cell": [0] * 900, "score": np.resize(scores, 900), "y": np.arange(900) % 2, "h": h})
        out = resample._cell_edges(70)(cell)
        assert sum(weighted) == 900 * 70
        w = np.concatenate([plain(h, d) for d in resample._chunks(70)], 1)
        assert np.allclose(np.concatenate(out["all_pos"].to_pylist()), (w * (np.arange(900) % 2)[:, None]).sum(0))


def test_poisson_weights_follow_their_probabilities():
    h = np.random.default_rng(3).integers(-2**62, 2**62, 20_000)
    w = resample.poisson_weights(h, np.arange(4))
    u = np.array([0.0, *resample._POISSON_CDF])
    for k in range(4):
        assert abs((w == k).mean() - (u[k + 1] - u[k])) < 0.01


def test_ranges_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    rows = spark.range(2_000).select((F.col("id") % 2).alias("k"), "id")
    found = ordered.ordered_scan(rows.localCheckpoint(), ["k"], ["id"], position="at")
    assert found.groupBy("k").agg(F.max("at").alias("n"), F.count_distinct("at").alias("d")).where("n = 1000 AND d = 1000").count() == 2
    assert ordered._ranges(rows) == 20
    monkeypatch.setattr(ordered, "RANGE_ROWS", 1_500)
    assert ordered._ranges(rows) is None


def test_cluster_blocks_and_forest_scores_use_all_cores(spark):
    rows = one_partition(spark, 500)
    cores = spark.sparkContext.defaultParallelism
    assert clusters.row_blocks(rows).getNumPartitions() == cores
    model = anomaly.IsolationForest(["id"], "id", trees=2).fit(rows)
    assert model.transform(rows).rdd.getNumPartitions() == cores


def test_freed_shuffle_files_go_with_the_write(spark):
    """A write that frees its shuffles leaves none for the driver's garbage collection, and the setting as it was."""
    def shuffles() -> set[str]:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
        return {f for f in files.split("|") if "/shuffle_" in f}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting), shuffles()
    written = materialize(spark.range(5_000).groupBy((F.col("id") % 100).alias("k")).count(), free=True)
    until = time.time() + 10
    while shuffles() - before and time.time() < until:  # files go in the background
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(setting) == was and written.count() == 100


def test_joint_codes_add_up_to_the_sums_of_each_feature():
    """Any numbers of bins, features that are not used, nodes: as one sum per feature and bin; few codes stand for many features."""
    rng = np.random.default_rng(3)
    sizes = [256, 1, 7, 300 // 3, *[2] * 30, 10, 256]
    first = np.concatenate([[0], np.cumsum(sizes)])
    columns = np.stack([rng.integers(0, n, 5_000) for n in sizes]).astype(np.uint8)
    used = np.sort(rng.choice(len(sizes), 30, replace=False))
    node, weights = rng.integers(0, 3, 5_000), (rng.normal(size=5_000), rng.random(5_000))
    codes = boosting.Codes(first, used)
    assert len(codes.groups) < len(used) / 2
    own = np.zeros((3, 2, codes.total))
    codes.add(own, codes.of(columns), node, weights)
    got, want = codes.bins(own), np.zeros((3, 2, first[-1]))
    for f in used:
        for j, w in enumerate(weights):
            np.add.at(want[:, j], (node, first[f] + columns[f]), w)
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_models_beyond_65536_rows_grow_in_one_task_and_only_lighter_children_are_summed(spark, monkeypatch):
    """400 rounds of four jobs were most of the time of models that one task holds easily; passes of larger ones skip what follows by subtraction."""
    rows = spark.range(70_000).selectExpr("'a' model", "id", "cast(id % 7 in (1, 3, 4) as int) label", "true train", "array(cast(id % 7 as double), cast(id % 11 as double)) features")
    s = boosting.Settings(rounds=2, depth=3, columns=1.0)
    asked = []
    monkeypatch.setattr(boosting, "_level_sums", lambda *a, sums=boosting._level_sums: asked.append(a[-1]["a"]) or sums(*a))
    alone, _ = boosting.fit_boosted(rows, "id", s)
    assert not asked
    monkeypatch.setattr(boosting, "ALONE_BYTES", 70_000)
    passes, _ = boosting.fit_boosted(rows, "id", s)
    for a, b in zip(alone["a"].trees, passes["a"].trees):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value, rtol=0, atol=1e-9)
    assert asked and not any(n % 2 and n + 1 in nodes for nodes in asked for n in nodes)


def test_leaf_masks_are_bytes_for_all_rows_at_once():
    """One byte a row per leaf from features x rows, open ranges at both ends included."""
    leaf = tree_shap.Leaf(0.5, np.array([0, 2]), np.array([0, 3]), np.array([7, 257]))
    columns = np.array([[6, 7, 0, 255], [9, 9, 9, 9], [3, 3, 2, 255]], np.uint8)
    masks = leaf.masks(columns)
    assert masks.dtype == np.uint8 and masks.tolist() == [3, 2, 1, 2]
