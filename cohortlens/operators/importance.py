"""Permutation importance and Shapley attribution."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.functions.cleaning import source_feature
from cohortlens.functions.rates import ratio_or_zero
from cohortlens.operators.boosting import Model, _matrix, sigmoid
from cohortlens.operators.evaluation import rank_metrics
from cohortlens.operators.folds import SEED, hash_sample, key_hash
from cohortlens.operators.tree_shap import background_rows, tree_contributions
from cohortlens.session import spread
from cohortlens.sources.tables import write_metadata, write_rows

#: Rows whose columns are shuffled among each other.
BLOCK_ROWS = 8_192


def permutation_importance(
    held_out: DataFrame, fold: str, labels: list[str], key: str, groups: dict[int, dict[str, list[int]]],
    models: dict[tuple[str, int], Callable[[np.ndarray], np.ndarray]], repeats: int = 3, seed: int = SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Held-out average-precision drop when one feature is shuffled within its fold, over all rows:
    (label, fold, feature, repeat, ap_decrease).

    ``held_out`` holds the key, the fold, 0/1 ``labels`` and ``features`` (array of doubles) as the
    fold's model takes them; ``groups[fold]`` names the entries that belong to a source feature, which
    are shuffled together; ``models[label, fold]`` scores a matrix of rows. Rows are dealt by hash into
    blocks of about ``block_rows``, and a row's donor is a row of its block, so one pass over the blocks
    scores every feature, repeat and label. A block is a random part of its fold, and a small fold is one block.
    """
    sizes = {r[fold]: r["n"] for r in held_out.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).collect()}  # a few folds
    blocks = F.lit(1)
    for value, n in sizes.items():
        blocks = F.when(F.col(fold) == value, max(1, n // block_rows)).otherwise(blocks)
    rows = held_out.select(F.col(fold).cast("int").alias("fold"), key, "features", *[F.col(y).cast("double").alias(y) for y in labels]).withColumn(
        "_block", F.pmod(key_hash(key, seed), blocks).cast("int")).withColumn("_h", key_hash(key, seed + 1))
    order = ["label", "fold", "feature", "repeat", "y", "score"]
    schema = "label string, fold int, feature string, repeat int, y int, score double"

    def score(block: pa.Table) -> pa.Table:
        at = block["fold"][0].as_py()
        block = block.take(np.lexsort((block[key].to_numpy(), block["_h"].to_numpy())))  # whatever order the rows came in
        x = _matrix(block["features"].combine_chunks(), max(max(g, default=-1) for g in groups[at].values()) + 1)
        y = {name: block[name].to_numpy().astype(np.int32) for name in labels}
        out = []
        for i, (feature, places) in enumerate([("", []), *sorted(groups[at].items())]):
            for repeat in range(repeats if feature else 1):
                donor = np.random.default_rng([seed, at, block["_block"][0].as_py(), i, repeat]).permutation(len(x))
                shuffled = x.copy()
                shuffled[:, places] = x[donor][:, places]
                for name in labels:
                    out.append((name, feature, repeat, y[name], models[name, at](shuffled)))
        n = len(x)
        columns = [pa.array(np.repeat([o[0] for o in out], n)), pa.array(np.full(n * len(out), at, np.int32)), pa.array(np.repeat([o[1] for o in out], n)),
                   pa.array(np.repeat(np.array([o[2] for o in out], np.int32), n)), pa.array(np.concatenate([o[3] for o in out])),
                   pa.array(np.concatenate([o[4] for o in out]))]
        return pa.table(columns, names=order)

    scored = spread(rows, "fold", "_block").groupBy("fold", "_block").applyInArrow(score, schema)
    ap = rank_metrics(scored, "y", ["label", "fold", "feature", "repeat"]).select("label", "fold", "feature", "repeat", "pr_auc")
    base = ap.where("feature = ''").select("label", "fold", F.col("pr_auc").alias("base"))
    # one row per label and fold
    return ap.where("feature <> ''").join(F.broadcast(base), ["label", "fold"]).select(
        "label", "fold", "feature", "repeat", (F.col("base") - F.col("pr_auc")).alias("ap_decrease"))


@dataclass(frozen=True)
class LogisticScore:
    """Probability of a fitted logistic model, for matrices."""

    weights: tuple[float, ...]
    constant: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ np.array(self.weights) + self.constant)


def importance_summary(drops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and sd over folds and repeats, ranked from the largest mean (ties share a rank)."""
    keys = keys or []
    out = drops.groupBy(*keys, "feature").agg(
        F.avg("ap_decrease").alias("mean_ap_decrease"), F.stddev_samp("ap_decrease").alias("repeat_sd"))
    w = Window.partitionBy(*keys).orderBy(F.desc("mean_ap_decrease"))  # one row per feature
    return out.withColumn("rank", F.rank().over(w))


def shapley_contributions(rows: DataFrame, key: str, model: Model, background: int = 100, probability: bool = True, seed: int = SEED) -> DataFrame:
    """Exact interventional Shapley values of boosted trees, one row per key of all ``rows``: (key, base, p, phi).

    ``rows`` holds the key and ``features``; the background is a seeded sample of ``background`` rows.
    """
    sample = hash_sample(rows.select(key, "features"), key, background, seed + 1)
    return tree_contributions(rows, key, model, background_rows(sample, background), probability)


def write_contributions(contributions: DataFrame, names: list[str], path: str) -> None:
    """Row-level contribution arrays as Parquet, and the names of their entries with base values beside them."""
    write_rows(contributions, f"{path}/contributions")
    # one row: the base is the same for all rows of a model
    write_metadata(contributions.agg(F.min("base").alias("base_low"), F.max("base").alias("base_high"), F.count(F.lit(1)).alias("n_rows"))
                   .withColumn("names", F.array(*[F.lit(n) for n in names])), f"{path}/names")


def read_contributions(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, encoded_feature, phi) of what ``write_contributions`` wrote."""
    names = spark.read.json(f"{path}/names").first()["names"]
    return contribution_rows(spark.read.parquet(f"{path}/contributions"), key, names)


def additivity_error(contributions: DataFrame) -> DataFrame:
    """Largest |base + sum(phi) - p|, one row."""
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)
    return contributions.agg(F.max(F.abs(F.col("base") + total - F.col("p"))).alias("max_additivity_error"))


def contribution_rows(contributions: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, encoded_feature, phi) rows of contribution arrays."""
    labels = F.array(*[F.lit(n) for n in names])
    return contributions.select(key, F.posexplode("phi").alias("_i", "phi")).select(
        key, F.get(labels, F.col("_i")).alias("encoded_feature"), "phi")


def encoded_importance(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Mean absolute contribution per encoded feature, ranked; one row per vector entry."""
    out = rows.groupBy("encoded_feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    w = Window.orderBy(F.desc("mean_abs_shap"), "encoded_feature")
    return out.select("encoded_feature", source_feature(F.col("encoded_feature"), sources).alias("source_feature"),
                      "mean_abs_shap", F.row_number().over(w).cast("long").alias("rank"))


def source_importance(rows: DataFrame, key: str, sources: list[str]) -> DataFrame:
    """Signed contributions summed per row and source first, then mean magnitude, share and rank."""
    signed = rows.groupBy(key, source_feature(F.col("encoded_feature"), sources).alias("source_feature")).agg(
        F.sum("phi").alias("phi"))
    out = signed.groupBy("source_feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    w = Window.orderBy(F.desc("mean_abs_shap"), "source_feature")
    total = F.sum("mean_abs_shap").over(Window.partitionBy())
    return out.select(
        "source_feature", "mean_abs_shap", ratio_or_zero(100 * F.col("mean_abs_shap"), total).alias("importance_pct"),
        F.row_number().over(w).cast("long").alias("rank"))
