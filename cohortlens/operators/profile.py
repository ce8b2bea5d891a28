"""Descriptive profiles: counts, shares, numeric shape, outcome rates, co-occurrence."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.cleaning import missing
from cohortlens.functions.rates import pooled_d, ratio, wald, wilson
from cohortlens.operators.ordered import ordered_scan
from cohortlens.operators.quantiles import LIMIT, exact_quantiles
from cohortlens.session import is_scan, materialize


def tall_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One aggregate pass, one (metric, value) row per entry; sums over no rows are null."""
    return (
        df.agg(*[m.cast("bigint").alias(name) for name, m in metrics.items()])
        .unpivot([], list(metrics), "metric", "value")
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts per value and their share of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(column, "n", ratio(F.col("n"), total).alias("share"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Zero-filled contingency table over the given column values."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def missing_percent(df: DataFrame, sentinel: str = "?") -> DataFrame:
    """Percent missing per column, columns without missing values left out, largest first."""
    wide = df.agg(*[(100.0 * F.avg(missing(c, sentinel).cast("int"))).alias(c) for c in df.columns])
    return (
        wide.unpivot([], df.columns, "column", "pct_missing")
        .where(F.col("pct_missing") > 0)
        .orderBy(F.desc("pct_missing"), "column")
    )


def numeric_profile(df: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """n, moments, quartiles, zero share and 1.5-IQR outliers per column.

    One aggregate for all moments, the passes of the exact quartiles, and one count of outliers; no
    value is shuffled. Skewness and excess kurtosis are the population forms, null for a constant
    column. A column without values has no row.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    base = rows if is_scan(rows) else materialize(rows)
    q = {r["variable"]: r["q"] for r in exact_quantiles(base, columns, [0.25, 0.5, 0.75], limit).collect()}  # one row a column
    held = [c for c in columns if c in q]

    def facts(c: str) -> Column:
        x, n = F.col(f"`{c}`"), F.count(f"`{c}`")
        low, mid, high = q[c]
        far = 1.5 * (high - low)
        constant = F.min(x) == F.max(x)
        return F.struct(
            F.lit(c).alias("variable"), n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.lit(low).alias("q25"), F.lit(mid).alias("median"), F.lit(high).alias("q75"),
            F.when(~constant, F.skewness(x)).alias("skewness"), F.when(~constant, F.kurtosis(x)).alias("kurtosis"),
            (100.0 * F.count_if(x == 0) / n).alias("pct_zero"), F.count_if((x < low - far) | (x > high + far)).alias("outliers_1_5_iqr"))

    if not held:
        kinds = ["q25 double", "median double", "q75 double", "skewness double", "kurtosis double", "pct_zero double", "outliers_1_5_iqr bigint"]
        return df.sparkSession.createDataFrame([], ", ".join(["variable string", "n bigint", "mean double", "sd double", "min double", "max double", *kinds]))
    return base.agg(F.array(*[facts(c) for c in held]).alias("r")).select(F.inline("r"))


def dispersion(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample variance and their ratio per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    out = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return out.withColumn("dispersion_ratio", ratio(F.col("variance"), F.col("mean")))


def mean_difference(df: DataFrame, columns: list[str], group: Column) -> DataFrame:
    """Per column: means of the two groups (true / false), their ratio and pooled-SD difference,
    ordered by its magnitude."""
    long = df.select(group.cast("int").alias("_g"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["_g"], columns, "feature", "value")
    inside, outside = F.when(F.col("_g") == 1, F.col("value")), F.when(F.col("_g") == 0, F.col("value"))
    agg = long.groupBy("feature").agg(
        F.count(inside).alias("n1"), F.avg(inside).alias("m1"), F.var_samp(inside).alias("v1"),
        F.count(outside).alias("n0"), F.avg(outside).alias("m0"), F.var_samp(outside).alias("v0"))
    c = {k: F.col(k) for k in ("n1", "m1", "v1", "n0", "m0", "v0")}
    return agg.select(
        "feature", F.col("m0").alias("normal_mean"), F.col("m1").alias("anomaly_mean"),
        ratio(c["m1"], c["m0"]).alias("ratio"), pooled_d(**c).alias("cohens_d"),
    ).orderBy(F.abs("cohens_d").desc_nulls_last(), "feature")


def group_rates(df: DataFrame, group: str, outcome: str, min_size: int = 1) -> DataFrame:
    """Outcome rate, size and normal-approximation interval per group of at least ``min_size``."""
    agg = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("rate"))
    low, high = wald(F.col("rate"), F.col("n"))
    return agg.where(F.col("n") >= min_size).select(group, "n", "rate", low.alias("ci_low"), high.alias("ci_high"))


def rate_gradient(df: DataFrame, band: str, outcome: str) -> DataFrame:
    """Rates per ordered band and the lowest-to-highest band ratio, on every row."""
    rates = group_rates(df, band, outcome)
    ends = rates.agg(ratio(F.min_by("rate", band), F.max_by("rate", band))).scalar()
    return rates.select("*", ends.alias("first_to_last_ratio"))


def top_groups(df: DataFrame, group: str, measure: str, k: int) -> DataFrame:
    """The ``k`` groups with the largest mean of ``measure`` in percent."""
    return (
        df.groupBy(group).agg((100.0 * F.avg(F.col(measure).cast("int"))).alias("pct"))
        .orderBy(F.desc("pct"), F.asc(group)).limit(k)
    )


def cooccurrence(df: DataFrame, flags: list[str]) -> DataFrame:
    """For every ordered pair of 0/1 columns: counts, P(b given a) with Wilson interval, lift over P(b).

    All pairwise counts come from one aggregate of k(k+1) conditional sums.
    """
    both = {(a, b): F.sum(F.col(a).cast("bigint") * F.col(b).cast("bigint")) for a in flags for b in flags}
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[e.alias(f"_{i}") for i, e in enumerate(both.values())])
    total = {a: F.col(f"_{i}") for i, (a, b) in enumerate(both) if a == b}
    rows = F.array(*[
        F.struct(F.lit(a).alias("given"), F.lit(b).alias("condition"), total[a].alias("exposed_n"),
                 F.col(f"_{i}").alias("cooccurring_n"), ratio(total[b], F.col("_n")).alias("base_rate"))
        for i, (a, b) in enumerate(both)
    ])
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    p, low, high = wilson(F.col("cooccurring_n"), F.col("exposed_n"))
    return out.select(
        "given", "condition", "exposed_n", "cooccurring_n", "base_rate", p.alias("conditional_prevalence"),
        low.alias("prevalence_ci_low"), high.alias("prevalence_ci_high"),
        ratio(p, F.col("base_rate")).alias("prevalence_lift"))


def histogram(df: DataFrame, column: str, low: float, width: float, bins: int, by: str | None = None) -> DataFrame:
    """Fixed-width bins (last one closed above) with count and density; outside values are left out."""
    keys = [by] if by else []
    high = low + width * bins
    x = F.col(column)
    counts = (
        df.where((x >= low) & (x <= high))
        .withColumn("bin", F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*keys))  # at most `bins` rows per key
    return counts.select(
        *keys, "bin", (F.lit(low) + F.col("bin") * width).alias("bin_low"), "n",
        ratio(F.col("n"), total * width).alias("density"))


def auto_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram over the observed range."""
    x = F.col(column)
    span = df.agg(F.min(column).alias("_low"), ((F.max(column) - F.min(column)) / bins).alias("_step"))  # one row
    cell = F.coalesce(F.floor(F.try_divide(x - F.col("_low"), F.col("_step"))), F.lit(0))
    return (
        df.where(x.isNotNull()).join(F.broadcast(span)).groupBy(F.least(cell, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantile_bin_rates(
    df: DataFrame, columns: list[str], outcome: str, bins: int = 10, limit: int = LIMIT,
) -> DataFrame:
    """Outcome rate per quantile bin of each column.

    Right-closed bins, lowest edge included, repeated edges dropped. The edges are a few numbers a
    column; one pass over the rows counts all bins.
    """
    rows = df.select(F.col(outcome).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns])
    base = rows if is_scan(rows) else materialize(rows)
    q = {r["variable"]: list(dict.fromkeys(r["q"])) for r in exact_quantiles(base, columns, [i / bins for i in range(bins + 1)], limit).collect()}
    cells = [F.struct(F.lit(c).alias("variable"),
                      F.greatest(sum(((F.col(c) > e).cast("int") for e in edges), F.lit(-1)), F.lit(0)).alias("bin"),
                      F.col(c).isNotNull().alias("known")) for c, edges in q.items()]
    empty = "array<struct<variable:string,bin:int,known:boolean>>"
    long = base.select("_y", F.inline(F.array(*cells) if cells else F.array().cast(empty))).where("known")
    agg = long.groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_events"))
    agg = agg.select("variable", "bin", "n", ratio(F.col("_events"), F.col("n")).alias("rate"))
    low, high = wald(F.col("rate"), F.col("n"))
    return agg.select("variable", "bin", "n", "rate", low.alias("ci_low"), high.alias("ci_high"))


def encoding_spread(
    df: DataFrame, binned: list[str], any_none: list[str], outcome: str, bins: int = 10, limit: int = LIMIT,
) -> DataFrame:
    """First, last and range of the outcome rate (percentage points) under each column's encoding."""
    q = quantile_bin_rates(df, binned, outcome, bins, limit).select(
        "variable", "bin", F.col("rate"), F.lit("bins").alias("encoding"))
    flags = df.select(outcome, *[(F.col(c) > 0).cast("int").alias(c) for c in any_none]).unpivot(
        [outcome], any_none, "variable", "bin")
    b = flags.where(F.col("bin").isNotNull()).groupBy("variable", "bin").agg(F.avg(outcome).alias("rate")).select(
        "variable", "bin", "rate", F.lit("binary (any vs none)").alias("encoding"))
    g = q.unionByName(b).groupBy("variable", "encoding").agg(
        F.count(F.lit(1)).alias("levels"),
        (100 * F.min_by("rate", "bin")).alias("low_pct"), (100 * F.max_by("rate", "bin")).alias("high_pct"),
        (100 * (F.max("rate") - F.min("rate"))).alias("_range"))
    binary = F.col("encoding").startswith("binary")
    return g.select(
        F.col("variable").alias("feature"),
        F.when(binary, F.col("encoding")).otherwise(F.concat(F.col("levels").cast("string"), F.lit(" bins"))).alias("encoding"),
        "low_pct", "high_pct",
        F.when(binary, F.col("high_pct") - F.col("low_pct")).otherwise(F.col("_range")).alias("spread_pp"),
    ).orderBy(F.desc("spread_pp"), "feature")


def group_profile(df: DataFrame, group: str, outcome: str, inputs: list[str]) -> DataFrame:
    """Size, events, rate with Wilson interval and the mean of every input per group."""
    agg = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("bigint")).alias("events"),
        *[F.avg(c).alias(f"mean_{c}") for c in inputs])
    p, low, high = wilson(F.col("events"), F.col("n"))
    return agg.select(group, "n", "events", p.alias("event_rate"), low.alias("ci_low"), high.alias("ci_high"),
                      *[f"mean_{c}" for c in inputs])


def unpivot_means(profile: DataFrame, group: str) -> DataFrame:
    """``mean_*`` columns of a group profile as (group, feature, mean) rows."""
    cols = [c for c in profile.columns if c.startswith("mean_")]
    return profile.unpivot([group], cols, "feature", "mean").withColumn(
        "feature", F.expr("substring(feature, 6)"))


def rank_within(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Competition rank (ties share the lowest) by descending measure; for result tables."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc(measure))))


def pivot_first(df: DataFrame, row: str, column: str, values: list[str], measure: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.first(measure))


def rank_agreement(df: DataFrame, item: str, group: str, measure: str, groups: list[str], **scan: object) -> DataFrame:
    """Rank correlation between the item rankings of every two groups (average ranks for ties)."""
    ranked = df.select(item, group, F.col(measure).cast("double").alias("_m"))
    hist = ranked.groupBy(group, "_m").agg(F.count(F.lit(1)).alias("_n"))
    cum = ordered_scan(hist, [group], ["_m"], running={"_cum": "_n"}, **scan)
    ranks = cum.select(group, "_m", (F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2).alias("_r"))
    wide = ranked.join(ranks, [group, "_m"]).groupBy(item).pivot(group, groups).agg(F.first("_r"))
    pairs = [(a, b) for i, a in enumerate(groups) for b in groups[i + 1:]]
    agg = wide.agg(*[F.expr(f"CASE WHEN var_pop(`{a}`) > 0 AND var_pop(`{b}`) > 0 THEN corr(`{a}`, `{b}`) END").alias(f"_{i}")
                     for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("outcome_a"), F.lit(b).alias("outcome_b"),
                              F.col(f"_{i}").alias("spearman_rank_correlation")) for i, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def mean_and_sd(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("sd"))
