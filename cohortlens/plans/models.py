"""Registered model queries: fits differ by learner and random numbers, so these have no SQL twin."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators import anomaly, boosting, encode, evaluation, folds, importance, oof, phenotypes, profile, quality, regression, resample
from cohortlens.operators.association import adjust_fdr
from cohortlens.plans import encounters as E, fixtures as X, survey as S
from cohortlens.plans.queries import ATTRIBUTES, OUTCOME, query, rounded
from cohortlens.session import materialize, scratch_path

KEY = "patient_nbr"
LEAKY = "patient_encounter_count"
FEATURES = list(dict.fromkeys(E.NUMERIC + E.BINARY + E.CATEGORICAL + E.UTILIZATION))
#: Score tables of this session, by application, tables and content: the fits are shared by the reports on them.
_FITTED: dict[tuple[str, str, str], DataFrame] = {}


def fitted(spark, sf: str, name: str, build) -> DataFrame:
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _FITTED:
        _FITTED[at] = materialize(build())
    return _FITTED[at]


def model_rows(spark, sf) -> DataFrame:
    """Cohort features with folds, written once since every fit scans it many times."""
    E.check_features(FEATURES)
    df = X.cohort_features(spark, sf).select(
        KEY, "encounter_id", OUTCOME, "race", "age_band", LEAKY, *FEATURES)
    return materialize(folds.group_folds(materialize(df), KEY, [OUTCOME]))  # the cohort is read for the folds and for its rows


def encounter_prep(numeric: list[str] | None = None):
    return lambda: oof.prepared(numeric or E.NUMERIC, E.BINARY, E.CATEGORICAL, E.UTILIZATION, KEY)


ESTIMATORS = {
    "logistic": lambda n, pos: [oof.logistic(OUTCOME, n)],
    "linear_svm": oof.linear_svm(),
    "gradient_boosting": oof.boosted_trees(),
    "perceptron": lambda n, pos: [oof.perceptron(OUTCOME)],
}
FITTED = ["logistic", "linear_svm", "gradient_boosting"]
#: Probabilities among the fitted scores.
CALIBRATED = ["logistic", "gradient_boosting"]


def encounter_scores(df: DataFrame, names: list[str], numeric: list[str] | None = None) -> DataFrame:
    """(key, label, fold, scores) of the named models, written once."""
    return materialize(oof.out_of_fold(df, "fold", OUTCOME, KEY, encounter_prep(numeric), {n: ESTIMATORS[n] for n in names}))


def score_table(spark, sf) -> DataFrame:
    """(key, label, fold, rule and fitted scores, group columns): every row scored by models that never saw its patient.

    Fitted once a session and written; checked before any report reads it.
    """
    def build() -> DataFrame:
        df = model_rows(spark, sf)
        known = df.select(KEY, OUTCOME, F.col("number_inpatient").cast("double").alias("rule_baseline"), *ATTRIBUTES)
        return quality.one_to_one(encounter_scores(df, FITTED), known, KEY, OUTCOME).drop(f"{OUTCOME}_baseline")

    table = fitted(spark, sf, "scores", build)
    for score in CALIBRATED:
        evaluation.check_scored(table, KEY, OUTCOME, score, ATTRIBUTES)
    return table


@query("group_folds")
def group_folds(spark, sf):
    """Fold sizes over all retained encounters, several per patient."""
    df = folds.group_folds(X.silver(spark, sf).select(KEY, OUTCOME), KEY, [OUTCOME])
    return df.groupBy("fold").agg(
        F.count_distinct(KEY).alias("patients"), F.count(F.lit(1)).alias("n"), F.sum(OUTCOME).alias("events"))


@query("fold_leaks", """
WITH e AS (SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS positives FROM orders GROUP BY 1)
SELECT n_rows, positives::BIGINT AS positives, count(*) AS entities, 1::BIGINT AS folds_per_entity, (count(*) // 5)::BIGINT AS least, ((count(*) + 4) // 5)::BIGINT AS most
FROM e GROUP BY 1, 2""")
def fold_leaks(spark, sf):
    """Per profile (rows and positives of a customer): customers, folds each is found in, and the smallest and largest fold."""
    orders = X.table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    dealt = folds.group_folds(orders, "o_custkey", ["y"])
    entities = dealt.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("positives"),
                                              F.count_distinct("fold").alias("used"), F.min("fold").alias("fold"))
    sizes = entities.groupBy("n_rows", "positives").agg(
        F.count(F.lit(1)).alias("entities"), F.max("used").alias("folds_per_entity"),
        *[F.count_if(F.col("fold") == k).alias(f"_{k}") for k in range(folds.N_FOLDS)])
    by_fold = [F.col(f"_{k}") for k in range(folds.N_FOLDS)]
    return sizes.select("n_rows", "positives", "entities", "folds_per_entity", F.least(*by_fold).alias("least"), F.greatest(*by_fold).alias("most"))


@query("joint_folds")
def joint_folds(spark, sf):
    df = folds.joint_folds(X.survey_clean(spark, sf), "row_id", S.OUTCOMES)
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in S.OUTCOMES])


@query("hash_sample")
def hash_sample(spark, sf):
    return folds.hash_sample(X.table(spark, sf, "orders"), "o_orderkey", 1_000)


@query("logit_odds")
def logit_odds(spark, sf):
    fit = regression.fit_logit(X.cohort_features(spark, sf), OUTCOME, E.ODDS_TERMS)
    return rounded(regression.odds_table(spark, [fit]))


@query("logit_fit_statistics")
def logit_fit_statistics(spark, sf):
    df = materialize(X.survey_clean(spark, sf))
    return rounded(regression.fit_statistics(spark, [regression.fit_logit(df, y, S.FEATURES, S.CATEGORICAL) for y in S.OUTCOMES]))


@query("nested_lrt")
def nested_lrt(spark, sf):
    df = materialize(X.survey_clean(spark, sf))
    blocks = {"demographic": S.DEMOGRAPHIC, "clinical_behavior": S.CLINICAL_BEHAVIOR, "socioeconomic": S.SOCIOECONOMIC}
    out = None
    for y in S.OUTCOMES:
        t = regression.nested_table(df, y, blocks, S.CATEGORICAL)
        out = t if out is None else out.unionByName(t)
    return rounded(adjust_fdr(out).drop("significant_fdr_05").withColumnRenamed("p_adj", "p_adj_bh"))


@query("comorbidity")
def comorbidity(spark, sf):
    df = materialize(X.survey_clean(spark, sf))
    return rounded(regression.comorbidity_table(df, S.OUTCOMES, S.FEATURES, S.CATEGORICAL))


@query("calibration_line")
def calibration_line(spark, sf):
    df = materialize(X.scored_cohort(spark, sf).select(OUTCOME, "score_a", "score_b"))
    return rounded(regression.calibration_line(df, OUTCOME, ["score_a", "score_b"]))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf):
    df = materialize(X.scored_cohort(spark, sf).select(KEY, OUTCOME, *X.SCORES))
    draws = resample.bootstrap_ap(df, KEY, OUTCOME, X.SCORES)
    return rounded(resample.paired_differences(draws, [("score_a", "rule_baseline"), ("score_b", "rule_baseline")]))


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf):
    df = materialize(X.scored_cohort(spark, sf).select(KEY, OUTCOME, *X.SCORES))
    return rounded(resample.discrimination_with_intervals(df, KEY, OUTCOME, X.SCORES))


@query("oof_logistic")
def oof_logistic(spark, sf):
    return encounter_scores(model_rows(spark, sf), ["logistic"])


@query("oof_models")
def oof_models(spark, sf):
    """Discrimination of the rule and three fitted models on the same folds, with bootstrap intervals."""
    models = ["rule_baseline", *FITTED]
    table = score_table(spark, sf)
    points = evaluation.discrimination(table, OUTCOME, models)
    draws = resample.bootstrap_ap(table, KEY, OUTCOME, models)
    return rounded(points.join(resample.draw_intervals(draws), "model", "left"))


@query("model_differences")
def model_differences(spark, sf):
    """Paired differences in average precision between the models, over the same draws."""
    pairs = [("logistic", "rule_baseline"), ("gradient_boosting", "logistic"), ("gradient_boosting", "linear_svm"), ("gradient_boosting", "rule_baseline")]
    draws = resample.bootstrap_ap(score_table(spark, sf), KEY, OUTCOME, ["rule_baseline", *FITTED])
    return rounded(resample.paired_differences(draws, pairs))


@query("model_thresholds")
def model_thresholds(spark, sf):
    """Operating points of the boosted model's out-of-fold scores: fixed cut-offs, then top shares."""
    table = score_table(spark, sf)
    fixed = evaluation.threshold_table(table, OUTCOME, "gradient_boosting").withColumn("target_flagged_pct", F.lit(None).cast("double"))
    return rounded(fixed.unionByName(evaluation.top_fraction_table(table, OUTCOME, "gradient_boosting")))


@query("model_calibration")
def model_calibration(spark, sf):
    """Reliability bins of out-of-fold probabilities, each with its model's Brier score and calibration line."""
    table = score_table(spark, sf)
    summary = evaluation.brier(table, OUTCOME, CALIBRATED).join(regression.calibration_line(table, OUTCOME, CALIBRATED), "model")
    return rounded(evaluation.calibration_report(evaluation.reliability_bins(table, OUTCOME, CALIBRATED), summary))


@query("model_fairness")
def model_fairness(spark, sf):
    """Rates and intervals per group and cut-off for the boosted model's out-of-fold scores."""
    return rounded(evaluation.subgroup_audit(score_table(spark, sf), OUTCOME, "gradient_boosting", ATTRIBUTES))


@query("model_fairness_gaps")
def model_fairness_gaps(spark, sf):
    return rounded(evaluation.gap_table(evaluation.subgroup_audit(score_table(spark, sf), OUTCOME, "gradient_boosting", ATTRIBUTES)))


def leakage_scores(spark, sf) -> DataFrame:
    """(key, label, safe_model, with_future_count): the trees of both feature sets and all folds grow together."""
    df = quality.require_domain(model_rows(spark, sf), {LEAKY: quality.positive_count(LEAKY)})
    names = ["safe_model", "with_future_count"]
    vectors = oof.fold_features(df, "fold", OUTCOME, KEY, {names[0]: encounter_prep(), names[1]: encounter_prep([*E.NUMERIC, LEAKY])})
    long = oof.boosted_scores(vectors, OUTCOME, KEY, oof.boosted_trees(), "score")
    return long.groupBy(KEY).pivot("name", names).agg(F.first("score")).join(df.select(KEY, OUTCOME), KEY)


@query("leakage_sensitivity")
def leakage_sensitivity(spark, sf):
    """The same model with and without the future event count, on identical folds: both models' metrics, and their difference."""
    both = fitted(spark, sf, "leakage", lambda: leakage_scores(spark, sf))
    names = ["safe_model", "with_future_count"]
    points = resample.discrimination_with_intervals(both, KEY, OUTCOME, names)
    gap = resample.leakage_comparison(both, KEY, OUTCOME, *names).select(
        F.col("comparison").alias("model"), F.col("pr_auc_difference").alias("pr_auc"), "ci_low", "ci_high", "bootstrap_resamples", "excludes_zero")
    return rounded(points.unionByName(gap, allowMissingColumns=True))


@query("neural_benchmark")
def neural_benchmark(spark, sf):
    df = model_rows(spark, sf)
    net, base = encounter_scores(df, ["perceptron"]), encounter_scores(df, ["logistic"]).drop("fold")
    pair = materialize(quality.one_to_one(net, base, KEY, OUTCOME))
    return rounded(resample.discrimination_with_intervals(pair, KEY, OUTCOME, ["perceptron", "logistic"]))


def survey_prep() -> list:
    return [encode.FeatureEncoder(S.NUMERIC, S.BINARY, S.CATEGORICAL, drop_first=True)]


def survey_rows(spark, sf) -> DataFrame:
    df = quality.require_domain(X.survey_clean(spark, sf), {"complete": quality.complete(S.FEATURES + S.OUTCOMES)})
    return materialize(folds.joint_folds(df, "row_id", S.OUTCOMES))


@query("survey_models")
def survey_models(spark, sf):
    """Out-of-fold discrimination and Brier score of the three survey outcomes."""
    df = survey_rows(spark, sf)
    out = None
    for y in S.OUTCOMES:
        scored = materialize(oof.out_of_fold(
            df, "fold", y, "row_id", survey_prep, {"p": lambda n, pos: [oof.logistic(y, n)]}))
        row = resample.discrimination_with_intervals(scored, "row_id", y, ["p"], draws=300)
        row = row.join(evaluation.brier(scored, y, ["p"]).select("model", "brier_score"), "model").select(
            F.lit(y).alias("outcome"), *[c for c in row.columns if c != "model"], "brier_score")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("permutation_importance")
def permutation_importance(spark, sf):
    """Loss in average precision per feature, for each of the survey outcomes, over all respondents."""
    held, groups, models_ = oof.logistic_folds(survey_rows(spark, sf), "fold", S.OUTCOMES, "row_id", lambda: survey_prep()[0])
    drops = importance.permutation_importance(held, "fold", S.OUTCOMES, "row_id", groups, models_)
    return rounded(importance.importance_summary(drops, ["label"]).withColumnRenamed("label", "outcome"))


def explained(spark, sf) -> tuple[DataFrame, list[str]]:
    """Contributions of all rows to the boosted model fitted on all of them, and the names of their entries."""
    df = model_rows(spark, sf)
    ready = Pipeline(stages=encounter_prep()()).fit(df)
    rows = materialize(ready.transform(df).select(
        F.lit("all").alias("model"), KEY, F.col(OUTCOME).alias("label"), F.lit(True).alias("train"), vector_to_array("features").alias("features")))
    models, _ = boosting.fit_boosted(rows, KEY, oof.boosted_trees())
    return importance.shapley_contributions(rows, KEY, models["all"]), list(ready.stages[-1].columns())


@query("shapley_importance")
def shapley_importance(spark, sf):
    """Contributions of all rows, written as arrays and read back; signed sums per source column, then their mean magnitude."""
    phi, names = explained(spark, sf)
    path = scratch_path(spark)
    importance.write_contributions(phi, names, path)
    return rounded(importance.source_importance(importance.read_contributions(spark, path, KEY), KEY, E.CATEGORICAL))


def flagged_rows(spark, sf) -> DataFrame:
    df = materialize(X.cohort_features(spark, sf).select(KEY, OUTCOME, "diag_1_group", *E.UTILIZATION))
    return materialize(anomaly.anomaly_flags(df, E.UTILIZATION, KEY))


@query("anomaly_scores")
def anomaly_scores(spark, sf):
    return rounded(flagged_rows(spark, sf).select(KEY, "anomaly_score", "is_anomaly", OUTCOME))


@query("anomaly_profile")
def anomaly_profile(spark, sf):
    return rounded(profile.mean_difference(flagged_rows(spark, sf), E.UTILIZATION, F.col("is_anomaly")))


@query("anomaly_groups")
def anomaly_groups(spark, sf):
    return rounded(profile.top_groups(flagged_rows(spark, sf), "diag_1_group", "is_anomaly", 5))


def phenotype_tables(spark, sf, which: int) -> DataFrame:
    """Selection, assignments or profiles; clustered once a session."""
    names = ["selection", "assignments", "profiles"]

    def build() -> DataFrame:
        df = X.cohort_features(spark, sf).select(KEY, OUTCOME, *E.UTILIZATION)
        made = phenotypes.phenotypes(materialize(df), KEY, OUTCOME, E.UTILIZATION)
        for name, table in list(zip(names, made))[1:]:
            fitted(spark, sf, f"phenotype_{name}", lambda t=table: t)
        return made[0]

    first = fitted(spark, sf, "phenotype_selection", build)
    return first if which == 0 else _FITTED[spark.sparkContext.applicationId, sf, f"phenotype_{names[which]}"]


@query("phenotype_selection")
def phenotype_selection(spark, sf):
    """Silhouette and cost of the best restart for every number of clusters, over all rows."""
    return rounded(phenotype_tables(spark, sf, 0))


@query("phenotype_assignments")
def phenotype_assignments(spark, sf):
    return phenotype_tables(spark, sf, 1)


@query("phenotype_profiles")
def phenotype_profiles(spark, sf):
    return rounded(phenotype_tables(spark, sf, 2))
