"""One-hot encoding of columns with any number of levels: a written level table, joins, and sparse vectors.

The levels of all columns are counted and numbered on the cluster by one prefix scan and written; the
driver learns how many each column has. Rows get their level's number by a join per column, which
Spark broadcasts or shuffles by the written table's size, and vectors are assembled sparse, so neither
plan nor row grows with the levels.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators.encode import MISSING, RARE, pooled_levels
from cohortlens.operators.ordered import ordered_scan
from cohortlens.session import materialize


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


class WideEncoder(Estimator):
    """Standardised numerics, pass-through indicators and one-hot categories in one sparse vector.

    The vector holds the numerics, the indicators, then each category's levels in their order; levels
    seen fewer than ``min_count`` times share one entry, the column's last. Missing values are a level
    like any other. A level that was not fitted goes to the shared entry where there is one, and is
    all zero otherwise. An empty table has no levels.
    """

    def __init__(self, numeric: list[str], binary: list[str], categorical: list[str], min_count: int = 1, output: str = "features"):
        super().__init__()
        self.numeric, self.binary, self.categorical = list(numeric), list(binary), list(categorical)
        self.min_count, self.output = min_count, output

    def _fit(self, dataset: DataFrame) -> "WideEncoderModel":
        stats = dataset.agg(
            F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in self.numeric],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in self.numeric]).first()
        scale = {c: (float(stats[f"m_{c}"] or 0.0), float(stats[f"s_{c}"] or 0.0) or 1.0) for c in self.numeric}
        if not self.categorical:
            return WideEncoderModel(self, scale, None, {}, set())
        found = pooled_levels(dataset.select(*[_text(c).alias(c) for c in self.categorical]), self.categorical, self.min_count)
        kept = found.where(F.col("encoded") != RARE).select("feature", "level")
        levels = ordered_scan(kept, ["feature"], ["level"], position="place")
        levels = materialize(levels.select("feature", "level", (F.col("place") - 1).alias("place")))
        sizes = {c: 0 for c in self.categorical}
        sizes |= {r["feature"]: r["n"] for r in levels.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
        pooled = {r["feature"] for r in found.where(F.col("encoded") == RARE).select("feature").distinct().collect()}
        return WideEncoderModel(self, scale, levels, sizes, pooled)


class WideEncoderModel(Model):
    """``levels``: (feature, level, place), written; ``sizes``: fitted levels per column, without the shared entry."""

    def __init__(self, spec: WideEncoder, scale: dict, levels: DataFrame | None, sizes: dict[str, int], pooled: set[str]):
        super().__init__()
        self.spec, self.scale, self.levels, self.sizes, self.pooled = spec, scale, levels, sizes, pooled

    def width(self) -> int:
        return len(self.spec.numeric) + len(self.spec.binary) + sum(self.sizes.values()) + len(self.pooled)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, parts = dataset, []
        for i, c in enumerate(self.spec.numeric + self.spec.binary):
            mean, sd = self.scale.get(c, (0.0, 1.0))
            out = out.withColumn(f"_wide_n{i}", (F.col(c).cast("double") - mean) / sd)
            parts.append(f"_wide_n{i}")
        for i, c in enumerate(self.spec.categorical):
            n, shared = self.sizes[c], c in self.pooled
            if not n + shared:
                continue
            own = self.levels.where(F.col("feature") == c).select(F.col("level").alias(f"_wide_l{i}"), F.col("place").alias(f"_wide_p{i}"))
            out = out.withColumn(f"_wide_t{i}", _text(c)).join(own, F.col(f"_wide_t{i}") == F.col(f"_wide_l{i}"), "left")
            # one place behind the entries stands for a level that has none, and is dropped
            place = F.coalesce(F.col(f"_wide_p{i}"), F.lit(n)).cast("double")
            out = out.withColumn(f"_wide_i{i}", place).withMetadata(f"_wide_i{i}", {"ml_attr": {"type": "nominal", "num_vals": n + 1}})
            encoder = OneHotEncoder(inputCols=[f"_wide_i{i}"], outputCols=[f"_wide_v{i}"], dropLast=not shared)
            out = encoder.fit(out).transform(out)
            parts.append(f"_wide_v{i}")
        assembled = VectorAssembler(inputCols=parts, outputCol=self.spec.output).transform(out)
        return assembled.select(*dataset.columns, self.spec.output)
