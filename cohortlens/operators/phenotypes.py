"""Outcome-blind clusters: selection by silhouette, assignment, stability."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.rates import adjusted_rand
from cohortlens.operators.clusters import assign, best, fit_clusters
from cohortlens.operators.encode import FeatureEncoder
from cohortlens.operators.folds import SEED
from cohortlens.operators.profile import group_profile
from cohortlens.session import materialize

K_RANGE = (2, 3, 4, 5, 6)


def standardized_logs(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    """log1p of the features, standardised over the given rows, as a vector column."""
    logs = [f"_log_{c}" for c in features]
    wide = df.select("*", *[F.log1p(F.col(c).cast("double")).alias(n) for c, n in zip(features, logs)])
    return FeatureEncoder(logs, [], [], output=output).fit(wide).transform(wide).drop(*logs)


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, one row; only cell counts are shuffled."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: F.col(n).cast("double") * (F.col(n) - 1) / 2
    both = cells.agg(F.sum(pairs("n")).alias("s"), F.sum("n").alias("n"))
    left = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n"))).scalar()
    right = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n"))).scalar()
    return both.select(adjusted_rand(F.col("s"), left, right, pairs("n")).alias("adjusted_rand_index"))


def phenotypes(
    df: DataFrame, key: str, outcome: str, features: list[str], ks: list[int] = K_RANGE, restarts: int = 10, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selection, assignments, profiles): k by silhouette over all rows, final clusters, and their
    profile with the agreement of a second set of seeds.

    ``selection`` has the best restart of every k: (k, silhouette, cost, n). The lower k wins a tie.
    """
    vectors = materialize(standardized_logs(df.select(key, outcome, *features), features).withColumn("features", vector_to_array("features")))
    models = fit_clusters(vectors, key, list(ks), restarts, seed)
    if not models:
        raise ValueError("no rows to cluster")
    n = vectors.count()
    chosen = [best(models, k) for k in ks]
    selection = df.sparkSession.createDataFrame(
        [(m.k, m.silhouette, m.cost, n) for m in chosen], "k int, silhouette double, cost double, n long")
    final = max(chosen, key=lambda m: (m.silhouette, -m.k))
    other = best(fit_clusters(vectors, key, [final.k], restarts, seed + 1), final.k)
    both = materialize(assign(assign(vectors, final), other, "_other").drop("features"))
    stability = rand_index(both, "cluster", "_other").first()[0]
    profiles = group_profile(both, "cluster", outcome, features).withColumn("seed_stability_ari", F.lit(float(stability)))
    return selection, both.select(key, outcome, "cluster"), profiles
