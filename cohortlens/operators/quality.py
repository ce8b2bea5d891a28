"""Checks that raise, and the violation tables behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null or occur more than once, with their row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def require_unique_key(df: DataFrame, key: str) -> DataFrame:
    if not key_violations(df, key).isEmpty():
        raise ValueError(f"expected exactly one row per non-null {key}")
    return df


def domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row of violation counts; an unknown (null) rule result is a violation."""
    return df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def require_domain(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    bad = {k: v for k, v in domain_violations(df, rules).first().asDict().items() if v}
    if bad:
        raise ValueError(f"domain violations (rule: rows): {bad}")
    return df


def binary(c: str) -> Column:
    return F.col(c).isin(0, 1)


def probability(c: str) -> Column:
    return F.col(c).between(0, 1)


def positive_count(c: str) -> Column:
    x = F.col(c).cast("double")
    return (x >= 1) & (x == F.floor(x)) & (x < float("inf"))


def complete(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def split_entities(df: DataFrame, entity: str, fold: str) -> DataFrame:
    """Entities that appear in more than one fold."""
    return (
        df.groupBy(entity).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
        .where(F.col("lo") != F.col("hi")).select(entity)
    )


def consistency(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """Row counts of both sides and (key, label) pairs found on one side only, one row."""
    a = left.select(key, F.col(label).alias("_label"), F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = right.select(key, F.col(label).alias("_label"), F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    sides = a.unionByName(b).groupBy(key, "_label").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return sides.agg(
        F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"),
        F.count_if(F.col("_r") == 0).alias("left_only"), F.count_if(F.col("_l") == 0).alias("right_only"),
    )


def one_to_one(left: DataFrame, right: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Inner join of two tables with one row per key each; overlapping columns of the right side
    get the suffix ``_baseline``. Raises on repeated keys, lost rows or differing labels."""
    require_unique_key(left, key)
    require_unique_key(right, key)
    renamed = right.select(key, *[
        F.col(c).alias(f"{c}_baseline" if c in left.columns else c) for c in right.columns if c != key])
    if label is None:
        unmatched = left.join(renamed, key, "left_anti").isEmpty()
        if not unmatched:
            raise ValueError(f"rows without a partner by {key}")
    else:
        row = consistency(left, right, key, label).first()
        if row["left_only"]:
            raise ValueError(f"outcomes do not match by {key}: {row.asDict()}")
    return left.join(renamed, key)
