"""Deterministic folds and samples: hash of the key, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.cleaning import joint_label
from cohortlens.operators.ordered import ordered_scan

SEED = 42
N_FOLDS = 5


def key_hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def group_folds(
    df: DataFrame, entity: str, labels: list[str], k: int = N_FOLDS, seed: int = SEED, **scan: object,
) -> DataFrame:
    """Add ``fold`` so that an entity has one fold and every label pattern is spread evenly.

    Entities are reduced to a profile (rows and positives per label), then dealt round-robin in
    hash order within their profile; a profile that holds most entities is ranked in parallel. The
    first fold of the deal depends on the profile, so rare profiles do not pile up in one fold.
    Rows without an entity are one entity together.
    """
    profile = [F.count(F.lit(1)).alias("_rows"), *[F.sum(F.col(c).cast("int")).alias(f"_p{i}") for i, c in enumerate(labels)]]
    keys = ["_rows", *[f"_p{i}" for i in range(len(labels))]]
    entities = df.groupBy(entity).agg(*profile).withColumn("_u", key_hash(entity, seed))
    ranked = ordered_scan(entities, keys, ["_u", entity], position="_i", **scan)
    fold = F.pmod(F.col("_i") - 1 + F.pmod(F.xxhash64(*keys), F.lit(k)), F.lit(k)).cast("int")
    dealt = ranked.select(F.col(entity).alias("_entity"), fold.alias("fold"))
    return df.join(dealt, F.col(entity).eqNullSafe(F.col("_entity"))).drop("_entity")


def joint_folds(df: DataFrame, entity: str, labels: list[str], k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """Folds stratified on the joint pattern of several 0/1 labels, one row per entity."""
    folds = group_folds(df.withColumn("_joint", joint_label(labels)), entity, labels, k, seed)
    return folds.drop("_joint")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement, the lowest by key hash; all rows when there are fewer.

    The limit leaves one partition, so the rows are dealt out again by key for what follows.
    """
    return df.orderBy(key_hash(key, seed), key).limit(n).repartition(key)
