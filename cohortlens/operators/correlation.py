"""Rank correlation and collinearity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.cleaning import interval_label
from cohortlens.operators.ordered import mid_ranks
from cohortlens.session import is_scan, materialize

#: Ranks (16 bytes each) that may travel to every task.
CARRIED = 1_000_000


def _correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairwise Pearson correlations from one aggregate; null for a constant column."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    spread = [F.var_pop(c).alias(f"_v{i}") for i, c in enumerate(columns)]
    cov = [F.covar_pop(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)]
    wide = df.agg(*spread, *cov)
    at = {c: F.col(f"_v{i}") for i, c in enumerate(columns)}
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                      F.try_divide(F.col(f"_c{i}"), F.sqrt(at[a] * at[b])).alias("rho"))
             for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def spearman(df: DataFrame, columns: list[str], ranges: int | None = None, carried: int = CARRIED) -> DataFrame:
    """Rank correlation of every column pair (rows with a null in any of them left out); null for a constant column.

    Ranks are computed on distinct values and written. Up to ``carried`` of them, in all columns
    together, travel to the tasks as sorted arrays; one pass then looks all columns of a row up and adds
    products of centred ranks, without a shuffle of rows. Beyond that number rows meet the ranks column
    by column in joins.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    rows = rows if is_scan(rows) else materialize(rows)
    ranks = materialize(mid_ranks(rows, columns, ranges=ranges))
    if ranks.count() <= carried:
        return _carried(rows, ranks, columns)
    for c in columns:
        one = ranks.where(F.col("variable") == c).select(F.col("value").alias(c), F.col("mid_rank").alias(f"_r_{c}"))
        rows = rows.join(one, c)
    return _correlations(rows.select(*[F.col(f"_r_{c}").alias(c) for c in columns]), columns)


def _carried(rows: DataFrame, ranks: DataFrame, columns: list[str]) -> DataFrame:
    found = ranks.select("variable", "value", "mid_rank", "n").orderBy("variable", "value").toArrow()
    names, value, rank, count = (found[c].to_numpy() for c in ("variable", "value", "mid_rank", "n"))
    lookup = [(value[names == c], rank[names == c]) for c in columns]
    total = int(count[names == columns[0]].sum()) if len(count) else 0
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k))
        for batch in batches:
            # all columns have the mean rank (n + 1) / 2
            r = np.stack([own[np.searchsorted(values, batch.column(i).to_numpy())] for i, (values, own) in enumerate(lookup)]) - (total + 1) / 2
            sums += r @ r.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(sums.ravel())], names=["cell", "s"])

    added = {r["cell"]: r["s"] for r in rows.mapInArrow(run, "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()}
    at = np.array([added.get(i, 0.0) for i in range(k * k)]).reshape(k, k)
    out = [(a, b, float(at[i, j] / np.sqrt(at[i, i] * at[j, j])) if at[i, i] > 0 and at[j, j] > 0 else None)
           for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return rows.sparkSession.createDataFrame(out, "feature_a string, feature_b string, rho double")


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factor per column with its band.

    The diagonal of the inverse correlation matrix; the matrix is computed on the cluster and only
    its k x k entries reach the driver. Raises when a column is constant or collinear.
    """
    assembler = VectorAssembler(inputCols=columns, outputCol="_v")
    vec = assembler.transform(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    r = Correlation.corr(vec, "_v", "pearson").first()[0].toArray()
    if not np.isfinite(r).all() or np.linalg.matrix_rank(r) < len(columns):
        raise ValueError("a column is constant or a linear combination of others")
    vif = np.diag(np.linalg.inv(r))
    out = df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, vif)], "feature string, vif double")
    band = interval_label(F.col("vif"), [(5, "ok"), (10, "elevated")], "severe")
    return out.withColumn("flag", band).orderBy(F.desc("vif"))
