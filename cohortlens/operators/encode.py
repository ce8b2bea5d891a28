"""Feature encoding fitted on training rows only, usable in a ``pyspark.ml`` pipeline."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

RARE = "__infrequent__"
#: Level of rows without a value.
MISSING = "__missing__"
#: A feature vector with more levels per column than this is refused.
MAX_LEVELS = 10_000


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, level, n) over the string form of categorical columns."""
    return (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "feature", "level")
        .groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    )


def pooled_levels(df: DataFrame, columns: list[str], min_count: int) -> DataFrame:
    """Every level with the level it is encoded as: itself, or the shared rare level."""
    return level_counts(df, columns).withColumn(
        "encoded", F.when(F.col("n") >= min_count, F.col("level")).otherwise(F.lit(RARE)))


def _level(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


class FeatureEncoder(Estimator):
    """Standardised numerics, pass-through indicators and one-hot categories in one vector.

    ``min_count`` pools levels seen fewer times in the training rows; unknown levels go to the
    pool when there is one. Missing values are a level like any other. ``drop_first`` leaves out the first level, and unknown levels are
    then all zero.
    """

    def __init__(self, numeric: list[str], binary: list[str], categorical: list[str],
                 min_count: int = 1, drop_first: bool = False, output: str = "features"):
        super().__init__()
        self.numeric, self.binary, self.categorical = list(numeric), list(binary), list(categorical)
        self.min_count, self.drop_first, self.output = min_count, drop_first, output

    def _fit(self, dataset: DataFrame) -> "FeatureEncoderModel":
        stats = dataset.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in self.numeric],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in self.numeric]).first()
        scale = {c: (float(stats[f"m_{c}"]), float(stats[f"s_{c}"]) or 1.0) for c in self.numeric}
        levels: dict[str, list[str]] = {c: [] for c in self.categorical}
        pooled: set[str] = set()
        if self.categorical:
            # frequent levels plus one pool row per column; bounded by the check below
            kept = (
                pooled_levels(dataset.select(*[_level(c).alias(c) for c in self.categorical]), self.categorical, self.min_count)
                .groupBy("feature", "encoded").agg(F.sum("n").alias("n"))
            )
            bound = MAX_LEVELS * len(self.categorical)
            rows = kept.limit(bound + 1).collect()
            if len(rows) > bound:
                raise ValueError("too many levels for one-hot encoding; raise min_count")
            for r in rows:
                if r["encoded"] == RARE:
                    pooled.add(r["feature"])
                else:
                    levels[r["feature"]].append(r["encoded"])
        return FeatureEncoderModel(self, scale, {c: sorted(v) for c, v in levels.items()}, pooled)


class FeatureEncoderModel(Model):
    def __init__(self, spec: FeatureEncoder, scale: dict, levels: dict[str, list[str]], pooled: set[str]):
        super().__init__()
        self.spec, self.scale, self.levels, self.pooled = spec, scale, levels, pooled

    def columns(self) -> dict[str, Column]:
        """Encoded name to expression, in vector order."""
        out: dict[str, Column] = {}
        for c in self.spec.numeric:
            mean, sd = self.scale[c]
            out[f"num__{c}"] = (F.col(c).cast("double") - mean) / sd
        for c in self.spec.binary:
            out[f"bin__{c}"] = F.col(c).cast("double")
        for c in self.spec.categorical:
            value = _level(c)
            levels = self.levels[c][1:] if self.spec.drop_first else self.levels[c]
            for level in levels:
                out[f"cat__{c}_{level}"] = F.coalesce((value == level).cast("double"), F.lit(0.0))
            if c in self.pooled and not self.spec.drop_first:
                known = F.coalesce(value.isin(self.levels[c]), F.lit(False)) if self.levels[c] else F.lit(False)
                out[f"cat__{c}_{RARE}"] = (~known).cast("double")
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.columns()
        tmp = [f"_enc_{i}" for i in range(len(cols))]
        wide = dataset.select("*", *[e.alias(t) for t, e in zip(tmp, cols.values())])
        assembled = VectorAssembler(inputCols=tmp, outputCol=self.spec.output).transform(wide)
        return assembled.drop(*tmp)


def design_columns(df: DataFrame, columns: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns as doubles, categories as 0/1 columns without their first level (numbers in numeric
    order). Returns the widened DataFrame and the term names; the constant is the fit's intercept."""
    cats = [c for c in columns if c in categorical]
    found: dict[str, list] = {c: [] for c in cats}
    if cats:
        bound = MAX_LEVELS * len(cats)
        rows = level_counts(df, cats).where(F.col("level").isNotNull()).limit(bound + 1).collect()
        if len(rows) > bound:
            raise ValueError("too many levels for dummy columns")
        for r in rows:
            found[r["feature"]].append(r["level"])

    def rank(level: str):
        try:
            return (0, float(level), level)
        except ValueError:
            return (1, 0.0, level)

    plain = {c: F.col(c).cast("double") for c in columns if c not in cats}
    dummies = {f"{c}_{v}": (F.col(c).cast("string") == v).cast("double")
               for c in cats for v in sorted(found[c], key=rank)[1:]}
    terms = {**plain, **dummies}
    return df.select("*", *[e.alias(f"x_{name}") for name, e in terms.items()]), list(terms)
