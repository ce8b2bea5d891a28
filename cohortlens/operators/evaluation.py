"""Audit of score columns against a binary label.

Rank metrics work on the (model, score) histogram: rows are aggregated map-side to distinct
scores, then one split-safe ordered scan gives cumulative counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.rates import ratio, ratio_or_zero, wilson
from cohortlens.operators import quality
from cohortlens.operators.ordered import ordered_scan
from cohortlens.operators.quantiles import LIMIT, exact_quantiles

#: Prespecified operating points.
THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.25]
TOP_FRACTIONS = [0.05, 0.10, 0.20]
MIN_DENOMINATOR = 20


def long_scores(df: DataFrame, label: str, models: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., label, model, score) rows."""
    ids = [*(keep or []), label]
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in models]).unpivot(ids, models, "model", "score")


def score_counts(scores: DataFrame, label: str, keys: list[str], **scan: object) -> DataFrame:
    """Distinct scores per key with positives, negatives, running counts and totals."""
    hist = scores.groupBy(*keys, "score").agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
    )
    return ordered_scan(
        hist, keys, ["score"], running={"cum_pos": "pos", "cum_neg": "neg"},
        totals={"all_pos": "pos", "all_neg": "neg"}, **scan)


def rank_metrics(scores: DataFrame, label: str, keys: list[str], **scan: object) -> DataFrame:
    """Average precision (step-wise, ties grouped) and ROC-AUC (ties count one half) per key."""
    c = score_counts(scores, label, keys, **scan)
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")  # at this score or above
    fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    agg = c.groupBy(*keys).agg(
        F.max("all_pos").alias("events"), F.max("all_neg").alias("_neg"),
        F.sum(F.col("pos") * F.try_divide(tp.cast("double"), (tp + fp).cast("double"))).alias("_ap"),
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2)).alias("_u"),
    )
    n = F.col("events") + F.col("_neg")
    ap = ratio(F.col("_ap"), F.col("events"))
    prevalence = ratio(F.col("events"), n)
    return agg.select(
        *keys, n.alias("n"), "events", prevalence.alias("prevalence"), ap.alias("pr_auc"),
        ratio(F.col("_u"), F.col("events") * F.col("_neg")).alias("roc_auc"), ratio(ap, prevalence).alias("lift"))


def discrimination(df: DataFrame, label: str, models: list[str], **scan: object) -> DataFrame:
    """Rank metrics per score column and for ``prevalence``, a constant score without information."""
    scores = long_scores(df.withColumn("prevalence", F.lit(0.0)), label, ["prevalence", *models])
    return rank_metrics(scores, label, ["model"], **scan)


def brier(df: DataFrame, label: str, models: list[str]) -> DataFrame:
    e = F.col("score") - F.col(label)
    return long_scores(df, label, models).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("event_rate"),
        F.avg(e * e).alias("brier_score"))


def _operating_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    n, flagged = tp + fp + tn + fn, tp + fp
    recall, specificity = ratio_or_zero(tp, tp + fn), ratio(tn, tn + fp)
    root = F.sqrt(flagged.cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "flagged_n": flagged, "flagged_pct": ratio(flagged, n), "tp": tp, "fp": fp, "tn": tn, "fn": fn,
        "sensitivity_recall": recall, "specificity": specificity,
        "ppv_precision": ratio_or_zero(tp, flagged), "npv": ratio(tn, tn + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        # the mean over the classes that occur
        "balanced_accuracy": F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall)
        .otherwise((recall + specificity) / 2),
        "mcc": ratio_or_zero(tp.cast("double") * tn - fp.cast("double") * fn, root),
        "accuracy": ratio(tp + tn, n), "event_capture_pct": ratio(100 * tp, tp + fn),
    }


def threshold_table(df: DataFrame, label: str, score: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Confusion counts and metrics at fixed cut-offs: one aggregate pass for all of them."""
    y, p = F.col(label) == 1, F.col(score)
    wide = df.agg(
        F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"),
        *[F.count_if(y & (p >= t)).alias(f"_tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(~y & (p >= t)).alias(f"_fp{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("_tp"), F.col(f"_fp{i}").alias("_fp"))
        for i, t in enumerate(thresholds)])
    long = wide.select("_pos", "_neg", F.explode(rows).alias("r")).select("_pos", "_neg", "r.*")
    tp, fp = F.col("_tp"), F.col("_fp")
    metrics = _operating_metrics(tp, fp, F.col("_neg") - fp, F.col("_pos") - tp)
    return long.select(F.lit("probability").alias("rule"), "threshold", *[c.alias(k) for k, c in metrics.items()])


def top_fraction_table(
    df: DataFrame, label: str, score: str, fractions: list[float] = TOP_FRACTIONS, **scan: object,
) -> DataFrame:
    """Flag the top share by score. The cut-off is the value at 0-based ordinal ceil((n-1)q), so
    ties at it can flag more than the target share."""
    counts = score_counts(long_scores(df, label, [score]), label, ["model"], **scan)
    n = F.col("all_pos") + F.col("all_neg")
    below = F.col("cum_pos") + F.col("cum_neg") - F.col("pos") - F.col("neg")
    ordinal = {f: F.ceil(F.round((n - 1) * F.lit(1 - f), 9)) for f in fractions}
    hit = [(below <= o) & (o < F.col("cum_pos") + F.col("cum_neg")) for o in ordinal.values()]
    rules = F.array(*[F.struct(F.lit(f).alias("f"), h.alias("hit")) for f, h in zip(fractions, hit)])
    at = counts.withColumn("_r", F.explode(rules)).where("_r.hit")
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    metrics = _operating_metrics(tp, fp, F.col("all_neg") - fp, F.col("all_pos") - tp)
    pct = F.floor(F.round(100 * F.col("_r.f"), 9)).cast("int").cast("string")
    return at.select(
        F.concat(F.lit("top_"), pct, F.lit("pct_risk")).alias("rule"), F.col("score").alias("threshold"),
        *[c.alias(k) for k, c in metrics.items()], (100 * F.col("_r.f")).alias("target_flagged_pct"))


def reliability_bins(
    df: DataFrame, label: str, models: list[str], bins: int = 10, eps: float = 1e-6, limit: int = LIMIT,
) -> DataFrame:
    """Mean prediction and observed rate per quantile bin; a score equal to an inner edge belongs
    to the lower bin and empty bins are dropped (``bin`` counts the remaining ones)."""
    clipped = df.select(label, *[F.least(F.greatest(F.col(m).cast("double"), F.lit(eps)), F.lit(1 - eps)).alias(m)
                                 for m in models])
    inner = [i / bins for i in range(1, bins)]
    # one row per model
    edges = exact_quantiles(clipped, models, inner, limit).select(F.col("variable").alias("model"), F.col("q").alias("_e"))
    long = long_scores(clipped, label, models).join(F.broadcast(edges), "model")
    agg = (
        long.groupBy("model", F.expr("size(filter(_e, e -> e < score))").alias("_b"))
        .agg(F.avg("score").alias("mean_predicted_probability"),
             F.avg(F.col(label).cast("double")).alias("observed_event_rate"), F.count(F.lit(1)).alias("n_bin"))
    )
    ranked = agg.withColumn("bin", F.row_number().over(Window.partitionBy("model").orderBy("_b")).cast("bigint"))  # at most `bins` rows per model
    return ranked.select("model", "bin", "n_bin", "mean_predicted_probability", "observed_event_rate")


def calibration_report(bins: DataFrame, summary: DataFrame) -> DataFrame:
    """Bins with their model's summary; the summary has one row per model."""
    return bins.join(F.broadcast(summary), "model", "left")


def check_scored(df: DataFrame, key: str, label: str, score: str, attributes: list[str]) -> DataFrame:
    """Columns present, one row per key, binary label, probability score; raises otherwise."""
    absent = [c for c in [key, label, score, *attributes] if c not in df.columns]
    if absent:
        raise ValueError(f"missing score columns: {sorted(absent)}")
    quality.require_unique_key(df, key)
    return quality.require_domain(df, {label: quality.binary(label), score: quality.probability(score)})


def subgroup_audit(
    df: DataFrame, label: str, score: str, attributes: list[str], thresholds: list[float] = THRESHOLDS,
    min_denominator: int = MIN_DENOMINATOR,
) -> DataFrame:
    """Counts, flagged rate, TPR and FPR with Wilson intervals per attribute, group and cut-off.

    Rows expand once per attribute; all cut-offs are conditional counts of the same aggregate.
    """
    cells = [F.coalesce(F.col(a).cast("string"), F.lit("Missing")).alias(a) for a in attributes]
    long = df.select((F.col(label) == 1).alias("_y"), F.col(score).alias("_p"), *cells).unpivot(
        ["_y", "_p"], attributes, "attribute", "group")
    y, p = F.col("_y"), F.col("_p")
    agg = long.groupBy("attribute", "group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("events"), F.count_if(~y).alias("non_events"),
        *[F.count_if(y & (p >= t)).alias(f"_tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(~y & (p >= t)).alias(f"_fp{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)])
    out = agg.select("attribute", "group", "n", "events", "non_events", F.explode(rows).alias("r")).select(
        "attribute", "group", "n", "events", "non_events", "r.*")
    tpr, tpr_lo, tpr_hi = wilson(F.col("tp"), F.col("events"))
    fpr, fpr_lo, fpr_hi = wilson(F.col("fp"), F.col("non_events"))
    flagged = F.col("tp") + F.col("fp")
    return out.select(
        F.lit(score).alias("model"), "attribute", "group", "threshold", "n", "events", "non_events", "tp", "fp",
        (F.col("non_events") - F.col("fp")).alias("tn"), (F.col("events") - F.col("tp")).alias("fn"),
        flagged.alias("flagged_n"), ratio(flagged, F.col("n")).alias("flagged_rate"),
        (F.col("events") < min_denominator).alias("small_event_count"),
        (F.col("non_events") < min_denominator).alias("small_non_event_count"),
        tpr.alias("tpr"), tpr_lo.alias("tpr_ci_low"), tpr_hi.alias("tpr_ci_high"),
        fpr.alias("fpr"), fpr_lo.alias("fpr_ci_low"), fpr_hi.alias("fpr_ci_high"))


def gap_table(audit: DataFrame, min_denominator: int = MIN_DENOMINATOR) -> DataFrame:
    """Largest minus smallest TPR and FPR among groups with enough cases; at least two needed.
    On ties the alphabetically first group is named."""
    sides = {"tpr": "events", "fpr": "non_events"}
    aggs = []
    for metric, denominator in sides.items():
        ok, m = F.col(denominator) >= min_denominator, F.col(metric)
        aggs += [
            F.count_if(ok).alias(f"_n_{metric}"),
            F.min(F.when(ok, F.struct((-m).alias("v"), "group"))).alias(f"_hi_{metric}"),
            F.min(F.when(ok, F.struct(m.alias("v"), "group"))).alias(f"_lo_{metric}"),
        ]
    rows = []
    for metric in sides:
        enough = F.col(f"_n_{metric}") >= 2
        rows.append(F.struct(
            F.lit(metric).alias("metric"), F.col(f"_n_{metric}").alias("eligible_groups"),
            F.lit(min_denominator).alias("minimum_denominator"),
            F.when(enough, -F.col(f"_hi_{metric}.v") - F.col(f"_lo_{metric}.v")).alias("max_minus_min"),
            F.when(enough, F.col(f"_hi_{metric}.group")).alias("highest_group"),
            F.when(enough, F.col(f"_lo_{metric}.group")).alias("lowest_group")))
    return audit.groupBy("attribute", "threshold").agg(*aggs).select("attribute", "threshold", F.inline(F.array(*rows)))
