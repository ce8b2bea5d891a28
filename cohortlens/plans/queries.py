"""Registered queries: name, DataFrame builder and, where SQL can say it, the comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions import cleaning as C
from cohortlens.operators import (
    association, cohort, correlation, distributions, encode, evaluation, phenotypes, profile, quality, quantiles, sequences,
)
from cohortlens.plans import encounters as E, fixtures as X, oracle as O, survey as S
from cohortlens.operators.importance import encoded_importance, source_importance
from cohortlens.sources.tables import table_fingerprint

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

OUTCOME = "readmitted_30d"
COUNTS = ["time_in_hospital", "num_lab_procedures", "num_medications", "num_procedures", "number_diagnoses",
          "number_inpatient", "number_emergency", "number_outpatient"]
ATTRIBUTES = ["race", "gender", "age_band"]
EVENT_STATES = {"FAILED": ["error"], "JOINED": ["signup"], "ACTIVE": ["view", "click"]}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded for comparison; ``other`` gives columns their own number of digits."""
    return df.select(*[F.round(F.col(f"`{n}`"), other.get(n, digits)).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


# ---------------------------------------------------------------- cleaning and cohort

_CLEAN = ["encounter_id", "patient_nbr", "race", "gender", "age_band", "admission_type_id", "discharge_disposition_id",
          "admission_source_id", "time_in_hospital", "medical_specialty", "payer_code", "number_inpatient", "diag_1",
          "diag_2", "diag_3", "max_glu_serum", "a1c_result", "glyburide-metformin", "med_change", "on_diabetes_med",
          "is_expired", "is_hospice", "readmitted", "readmitted_30d", "a1c_tested", "med_changed"]


@query("typed_clean", O.ENCOUNTERS + f"SELECT {', '.join(chr(34) + c + chr(34) for c in _CLEAN)} FROM silver")
def typed_clean(spark, sf):
    return X.silver(spark, sf).select(*[F.col(f"`{c}`") for c in _CLEAN])


@query("survey_clean", O.SURVEY + "SELECT * FROM survey")
def survey_clean(spark, sf):
    return X.survey_clean(spark, sf)


@query("code_group_ladder", O.ENCOUNTERS + """
SELECT encounter_id, diag_1, diag_1_group, age_midpoint, prior_visits_total FROM fact""")
def code_group_ladder(spark, sf):
    return E.fact_columns(X.silver(spark, sf)).select(
        "encounter_id", "diag_1", "diag_1_group", "age_midpoint", "prior_visits_total")


@query("brand_code_ladder", """
SELECT p_partkey, code, CASE WHEN code LIKE 'V%' OR code LIKE 'E%' THEN 'supplementary'
    WHEN n BETWEEN 390 AND 459 THEN 'circulatory' WHEN n BETWEEN 140 AND 239 THEN 'neoplasms'
    WHEN n BETWEEN 1 AND 139 THEN 'infectious' ELSE 'other' END AS code_group
FROM (SELECT *, TRY_CAST(code AS DOUBLE) AS n FROM (
  SELECT p_partkey, CASE WHEN p_type LIKE 'E%' THEN 'E' || regexp_extract(p_brand, '#(\\d+)', 1)
    ELSE regexp_extract(p_brand, '#(\\d+)', 1) END AS code FROM part))""")
def brand_code_ladder(spark, sf):
    digits = F.regexp_extract("p_brand", r"#(\d+)", 1)
    part = X.table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_type").like("E%"), F.concat(F.lit("E"), digits)).otherwise(digits).alias("code"))
    return part.withColumn("_n", C.number_or_null("code")).select(
        "p_partkey", "code", C.code_group("code", "_n").alias("code_group"))


@query("post_absorbing_exclusion", O.ENCOUNTERS + "SELECT patient_nbr FROM post_expired")
def post_absorbing_exclusion(spark, sf):
    return E.post_expired_patients(X.raw_encounters(spark, sf))


@query("encounter_sequence", O.ENCOUNTERS + """
SELECT encounter_id, patient_nbr, encounter_seq, patient_encounter_count FROM fact""")
def encounter_sequence(spark, sf):
    # only the columns that decide which rows are retained reach the window
    return cohort.sequence_events(X.silver(spark, sf).select("encounter_id", "patient_nbr"), "patient_nbr", ["encounter_id"])


@query("first_event_cohort", O.ENCOUNTERS + """
SELECT patient_nbr, encounter_id, race, gender, age_band, age_midpoint, diag_1_group, discharge_disposition_id,
  is_hospice, patient_encounter_count, readmitted_30d FROM fact WHERE encounter_seq = 1""")
def first_event_cohort(spark, sf):
    return E.first_cohort(X.silver(spark, sf)).select(
        "patient_nbr", "encounter_id", "race", "gender", "age_band", "age_midpoint", "diag_1_group",
        "discharge_disposition_id", "is_hospice", "patient_encounter_count", OUTCOME)


_FEATURES = ["n_active_diabetes_meds", "any_med_adjusted", "procedures_per_day", "meds_per_day", "labs_per_day",
             "log_number_inpatient", "log_number_emergency", "log_number_outpatient", "any_number_inpatient",
             "any_number_emergency", "any_number_outpatient", "high_prior_utilizer", "a1c_tested_and_changed",
             "is_hospice", "race", "medical_specialty", "payer_code", "max_glu_serum", "a1c_result"]
_FEATURE_SQL = ", ".join(f"round({c}, 6) AS {c}" if c.endswith("per_day") or c.startswith("log_") else c for c in _FEATURES)


@query("feature_rates", O.ENCOUNTERS + f"SELECT patient_nbr, {_FEATURE_SQL} FROM features")
def feature_rates(spark, sf):
    return rounded(X.cohort_features(spark, sf).select("patient_nbr", *_FEATURES))


@query("score_logits", O.ENCOUNTERS + """
SELECT patient_nbr, round(ln(least(greatest(score_a, 1e-6), 1 - 1e-6) / (1 - least(greatest(score_a, 1e-6), 1 - 1e-6))), 4)
  AS logit_a FROM scored""")
def score_logits(spark, sf):
    return rounded(X.scored_cohort(spark, sf).select("patient_nbr", C.clipped_logit(F.col("score_a")).alias("logit_a")), 4)


@query("joint_labels", O.SURVEY + """
SELECT row_id, CAST(has_diabetes + 2 * has_stroke + 4 * has_cardiac AS INTEGER) AS joint_label FROM survey""")
def joint_labels(spark, sf):
    return X.survey_clean(spark, sf).select("row_id", C.joint_label(S.OUTCOMES).alias("joint_label"))


@query("price_bands", """
SELECT o_orderkey, CASE WHEN o_totalprice <= 100000 THEN 'low' WHEN o_totalprice <= 300000 THEN 'middle' ELSE 'high' END
  AS band FROM orders""")
def price_bands(spark, sf):
    band = C.interval_label(F.col("o_totalprice"), [(100000, "low"), (300000, "middle")], "high")
    return X.table(spark, sf, "orders").select("o_orderkey", band.alias("band"))


_SOURCES = ["a1c_result", "gender", "max_glu_serum", "diag_1_group"]


@query("source_features", O.ENCOUNTERS + f"""
SELECT encoded, CASE WHEN encoded LIKE 'num%' THEN 'age_midpoint' ELSE feature END AS source_feature, n FROM (
SELECT 'cat__' || feature || '_' || level AS encoded, feature, count(*) AS n FROM (
  {O.stacked(_SOURCES, 'features', 'feature', 'level', cast='VARCHAR')}) GROUP BY 1, 2
UNION ALL SELECT 'num__age_midpoint', 'age_midpoint', count(*) FROM features)""")
def source_features(spark, sf):
    df = X.cohort_table(spark, sf, *_SOURCES)
    levels = encode.level_counts(df, _SOURCES).select(
        F.concat(F.lit("cat__"), "feature", F.lit("_"), "level").alias("encoded"), "n")
    numeric = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("num__age_midpoint").alias("encoded"), "n")
    both = levels.unionByName(numeric)
    return both.select("encoded", C.source_feature(F.col("encoded"), _SOURCES).alias("source_feature"), "n")


# ---------------------------------------------------------------- data quality and sequences

@query("dq_report", O.ENCOUNTERS + """
SELECT 'bronze_encounter_rows' AS metric, count(*) AS value FROM raw
UNION ALL SELECT 'silver_encounter_rows', count(*) FROM silver
UNION ALL SELECT 'dropped_expired', count(*) FROM typed WHERE discharge_disposition_id IN (11,19,20)
UNION ALL SELECT 'retained_hospice', CAST(sum(CASE WHEN is_hospice THEN 1 ELSE 0 END) AS BIGINT) FROM silver
UNION ALL SELECT 'dropped_unknown_gender', count(*) FROM raw WHERE gender NOT IN ('Male','Female')
UNION ALL SELECT 'distinct_patients', count(DISTINCT patient_nbr) FROM silver
UNION ALL SELECT 'readmit_30d_positives', CAST(sum(readmitted_30d) AS BIGINT) FROM silver
UNION ALL SELECT 'null_race', count(*) FROM silver WHERE race IS NULL
UNION ALL SELECT 'null_payer_code', count(*) FROM silver WHERE payer_code IS NULL
UNION ALL SELECT 'null_medical_specialty', count(*) FROM silver WHERE medical_specialty IS NULL
UNION ALL SELECT 'a1c_tested', CAST(sum(a1c_tested) AS BIGINT) FROM silver
UNION ALL SELECT 'brfss_rows', count(*) FROM customer
UNION ALL SELECT 'excluded_post_death_sequence', count(*) FROM post_expired""")
def dq_report(spark, sf):
    return E.dq_report(X.raw_encounters(spark, sf), X.survey_clean(spark, sf))


@query("disposition_audit", O.ENCOUNTERS + """
SELECT discharge_disposition_id AS disposition_id, count(*) AS n_encounters,
  round(100.0 * avg(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END), 3) AS pct_readmit_30d,
  CASE WHEN discharge_disposition_id IN (11,19,20) THEN 'excluded_expired'
       WHEN discharge_disposition_id IN (13,14) THEN 'retained_hospice' ELSE 'retained' END AS treatment
FROM typed GROUP BY 1""")
def disposition_audit(spark, sf):
    return E.disposition_audit(X.raw_encounters(spark, sf))


#: Fixed values, stated here on their own so that the operator's table is checked: code to state.
_STATE_SQL = """CASE WHEN discharge_disposition_id IN (1, 6, 8, 12, 18, 21, 25, 26) THEN 'HOME'
  WHEN discharge_disposition_id IN (2, 3, 4, 5, 10, 15, 16, 17, 22, 23, 24, 27, 28, 29, 30) THEN 'TRANSFERRED'
  WHEN discharge_disposition_id = 7 THEN 'LEFT_AMA' WHEN discharge_disposition_id = 9 THEN 'STILL_ADMITTED'
  WHEN discharge_disposition_id IN (11, 19, 20) THEN 'EXPIRED' WHEN discharge_disposition_id IN (13, 14) THEN 'HOSPICE'
  ELSE 'UNKNOWN' END"""
_TRANSITIONS = O.ENCOUNTERS + f""", states AS (
  SELECT encounter_id, patient_nbr, {_STATE_SQL} AS state FROM typed),
steps AS (SELECT *, lag(state) OVER w AS prev_state, lag(encounter_id) OVER w AS prev_encounter_id FROM states
  WINDOW w AS (PARTITION BY patient_nbr ORDER BY encounter_id)),
pairs AS (SELECT *, prev_state = 'EXPIRED' AS illegal, prev_state IN ('HOSPICE','LEFT_AMA') AS notable
  FROM steps WHERE prev_state IS NOT NULL)
"""


def _states(spark, sf):
    raw = X.raw_encounters(spark, sf).select(
        F.col("encounter_id").cast("bigint").alias("encounter_id"), F.col("patient_nbr").cast("bigint").alias("patient_nbr"),
        F.col("discharge_disposition_id").cast("int").alias("code"))
    return sequences.with_state(raw, "code", sequences.DISPOSITION_STATES).drop("code")


def _pairs(spark, sf):
    return sequences.transitions(_states(spark, sf), "patient_nbr", "encounter_id", ["encounter_id"])


@query("fsm_transitions", _TRANSITIONS + "SELECT * FROM pairs")
def fsm_transitions(spark, sf):
    return _pairs(spark, sf)


_STATES = [*sequences.DISPOSITION_STATES, "UNKNOWN"]


@query("fsm_matrix", _TRANSITIONS + "SELECT prev_state, " + ", ".join(
    f"count(*) FILTER (WHERE state = '{s}') AS \"{s}\"" for s in _STATES) + " FROM pairs GROUP BY prev_state")
def fsm_matrix(spark, sf):
    return sequences.transition_matrix(_pairs(spark, sf), _STATES)


@query("fsm_illegal", _TRANSITIONS + """
SELECT patient_nbr, prev_encounter_id, encounter_id, prev_state, state FROM pairs WHERE illegal""")
def fsm_illegal(spark, sf):
    return _pairs(spark, sf).where("illegal").select(
        "patient_nbr", "prev_encounter_id", "encounter_id", "prev_state", "state")


@query("fsm_summary", _TRANSITIONS + """
SELECT count(*) AS transitions, count(*) FILTER (WHERE illegal) AS illegal, count(*) FILTER (WHERE notable) AS notable
FROM pairs""")
def fsm_summary(spark, sf):
    return sequences.sequence_summary(_pairs(spark, sf))


@query("state_distribution", _TRANSITIONS + """
SELECT state, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM states), 6) AS share
FROM states GROUP BY state""")
def state_distribution(spark, sf):
    return rounded(profile.value_shares(_states(spark, sf), "state"))


@query("event_transitions", """
SELECT user_id, prev_state, state, count(*) AS n, count(*) FILTER (WHERE prev_state = 'FAILED') AS illegal,
  count(*) FILTER (WHERE prev_state = 'JOINED') AS notable
FROM (SELECT user_id, state, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_state FROM (
  SELECT *, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'JOINED' WHEN 'view' THEN 'ACTIVE'
    WHEN 'click' THEN 'ACTIVE' ELSE 'UNKNOWN' END AS state FROM events))
WHERE prev_state IS NOT NULL GROUP BY 1, 2, 3""")
def event_transitions(spark, sf):
    ev = X.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    pairs = sequences.transitions(
        sequences.with_state(ev, "event_type", EVENT_STATES), "user_id", "event_id", ["ts", "event_id"],
        illegal_from=["FAILED"], notable_from=["JOINED"])
    return pairs.groupBy("user_id", "prev_state", "state").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("illegal").alias("illegal"), F.count_if("notable").alias("notable"))


@query("post_error_users", """
SELECT DISTINCT a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id
WHERE a.event_type = 'error' AND a.value > 200""")
def post_error_users(spark, sf):
    return cohort.post_absorbing_entities(
        X.table(spark, sf, "events"), "user_id", "event_id", (F.col("event_type") == "error") & (F.col("value") > 200))


_LABELLED = ["lang", "source", "quality", "toxic"]


@query("missingness", "WITH d AS (SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) "
       + "SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", round(100.0 * avg(CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = '?' THEN 1 ELSE 0 END), 6) "
           f"AS pct_missing FROM d" for c in _LABELLED) + ") WHERE pct_missing > 0")
def missingness(spark, sf):
    docs = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id", "left").select(*_LABELLED)
    return rounded(profile.missing_percent(docs))


_RAW_COLUMNS = ["race", "gender", "payer_code", "medical_specialty", "diag_1", "diag_2", "diag_3", "readmitted"]


@query("raw_missingness", O.ENCOUNTERS + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(100.0 * avg(CASE WHEN {c} IS NULL OR {c} = '?' THEN 1 ELSE 0 END), 6) AS pct_missing FROM raw"
    for c in _RAW_COLUMNS) + ") WHERE pct_missing > 0")
def raw_missingness(spark, sf):
    return rounded(profile.missing_percent(X.raw_encounters(spark, sf).select(*_RAW_COLUMNS)))


@query("key_violations", """
SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL""")
def key_violations(spark, sf):
    return quality.key_violations(X.table(spark, sf, "lineitem"), "l_orderkey")


@query("domain_violations", """
SELECT count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)) AS discount,
  count(*) FILTER (WHERE NOT (l_quantity >= 1 AND l_quantity = floor(l_quantity))) AS quantity,
  count(*) FILTER (WHERE l_linenumber NOT IN (0, 1)) AS linenumber,
  count(*) FILTER (WHERE l_returnflag IS NULL OR l_linestatus IS NULL) AS complete FROM lineitem""")
def domain_violations(spark, sf):
    return quality.domain_violations(X.table(spark, sf, "lineitem"), {
        "discount": F.col("l_discount").between(0, 0.05), "quantity": quality.positive_count("l_quantity"),
        "linenumber": quality.binary("l_linenumber"), "complete": quality.complete(["l_returnflag", "l_linestatus"])})


@query("consistency", O.ENCOUNTERS + """,
respondents AS (SELECT c_custkey AS k, CAST(count(o_orderkey) >= 10 AS INTEGER) AS y FROM customer
  LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT (SELECT count(*) FROM features) AS left_rows, (SELECT count(*) FROM respondents) AS right_rows,
  (SELECT count(*) FROM features f WHERE NOT EXISTS (SELECT 1 FROM respondents WHERE k = f.patient_nbr AND y = f.readmitted_30d)) AS left_only,
  (SELECT count(*) FROM respondents WHERE NOT EXISTS (SELECT 1 FROM features f WHERE k = f.patient_nbr AND y = f.readmitted_30d)) AS right_only""")
def consistency(spark, sf):
    left = E.first_cohort(X.silver(spark, sf)).select("patient_nbr", F.col(OUTCOME).alias("y"))
    right = X.survey_clean(spark, sf).select(F.col("row_id").alias("patient_nbr"), F.col("high_bp").cast("int").alias("y"))
    return quality.consistency(left, right, "patient_nbr", "y")


@query("one_to_one_join", O.ENCOUNTERS + """
SELECT f.patient_nbr, f.readmitted_30d, f.age_band, c_mktsegment, c_nationkey
FROM features f JOIN customer ON c_custkey = f.patient_nbr""")
def one_to_one_join(spark, sf):
    left = E.first_cohort(X.silver(spark, sf)).select("patient_nbr", OUTCOME, "age_band")
    right = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_nbr"), "c_mktsegment", "c_nationkey")
    return quality.one_to_one(left, right, "patient_nbr")


_PRINTED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


@query("table_fingerprints", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws(chr(31), "
    + ", ".join(f"coalesce({c}::VARCHAR, chr(30))" for c in cols) + f")), 1, 8))::BIGINT)::BIGINT AS content_sum FROM {t}"
    for t, cols in _PRINTED.items()))
def table_fingerprints(spark, sf):
    names = list(_PRINTED)
    parts = [table_fingerprint(X.table(spark, sf, n), _PRINTED[n]).select(F.lit(n).alias("name"), "n_rows", "content_sum") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- profiles

_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(columns: list[str], source: str) -> str:
    return f"""
v AS ({O.stacked(columns, source)}),
q AS (SELECT variable, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM v GROUP BY variable)
SELECT v.variable, any_value(n) AS n, round(any_value(m), 7) AS mean, round(any_value(sd), 6) AS sd,
  any_value(lo) AS "min", round(any_value(q25), 6) AS q25, round(any_value(median), 6) AS median, round(any_value(q75), 6) AS q75,
  any_value(hi) AS "max",
  round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS skewness,
  round(avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3, 6) AS kurtosis,
  round(100.0 * avg(CASE WHEN value = 0 THEN 1 ELSE 0 END), 6) AS pct_zero,
  count(*) FILTER (WHERE value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS outliers_1_5_iqr
FROM v JOIN q ON v.variable = q.variable GROUP BY v.variable"""


_PROFILE_ORDER = ["variable", "n", "mean", "sd", "min", "q25", "median", "q75", "max", "skewness", "kurtosis", "pct_zero",
                  "outliers_1_5_iqr"]


@query("numeric_profile", "WITH " + _profile_sql(_LINE_NUMBERS, "lineitem"))
def numeric_profile(spark, sf):
    return rounded(profile.numeric_profile(X.table(spark, sf, "lineitem"), _LINE_NUMBERS).select(*_PROFILE_ORDER), mean=7)


@query("cohort_profile", O.ENCOUNTERS + "," + _profile_sql(COUNTS, "features"))
def cohort_profile(spark, sf):
    return rounded(profile.numeric_profile(X.cohort_table(spark, sf, *COUNTS), COUNTS).select(*_PROFILE_ORDER), mean=7)


@query("exact_quantiles", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
  round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY l_returnflag""")
def exact_quantiles(spark, sf):
    flags = ["A", "N", "R"]
    wide = X.table(spark, sf, "lineitem").select(
        *[F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")).alias(f) for f in flags])
    q = quantiles.exact_quantiles(wide, flags, [0.05, 0.5, 0.95])
    return rounded(q.select(F.col("variable").alias("l_returnflag"), F.col("q")[0].alias("q05"),
                            F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95")), 4)


@query("dispersion", O.ENCOUNTERS + f"""
SELECT variable, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance,
  round(var_samp(value) / avg(value), 6) AS dispersion_ratio FROM ({O.stacked(COUNTS, 'features')}) GROUP BY variable""")
def dispersion(spark, sf):
    return rounded(profile.dispersion(X.cohort_features(spark, sf), COUNTS))


@query("outcome_balance", O.ENCOUNTERS + """
SELECT readmitted, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM raw), 6) AS share FROM raw GROUP BY 1""")
def outcome_balance(spark, sf):
    return rounded(profile.value_shares(X.raw_encounters(spark, sf), "readmitted"))


def _d_sql(columns: list[str], source: str, group: str) -> str:
    return f"""
SELECT feature, round(m0, 6) AS normal_mean, round(m1, 6) AS anomaly_mean, round(m1 / NULLIF(m0, 0), 6) AS ratio,
  round((m1 - m0) / NULLIF(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / NULLIF(n1 + n0 - 2, 0)), 0), 6) AS cohens_d
FROM (SELECT feature, count(value) FILTER (WHERE g) AS n1, avg(value) FILTER (WHERE g) AS m1,
  var_samp(value) FILTER (WHERE g) AS v1, count(value) FILTER (WHERE NOT g) AS n0, avg(value) FILTER (WHERE NOT g) AS m0,
  var_samp(value) FILTER (WHERE NOT g) AS v0
  FROM ({O.stacked(columns, source, 'feature', 'value', f'({group}) AS g')}) GROUP BY feature)"""


@query("cohens_d_profile", O.ENCOUNTERS + _d_sql(E.UTILIZATION, "features", "readmitted_30d = 1"))
def cohens_d_profile(spark, sf):
    return rounded(profile.mean_difference(X.cohort_features(spark, sf), E.UTILIZATION, F.col(OUTCOME) == 1))


@query("line_mean_difference", _d_sql(_LINE_NUMBERS, "lineitem", "l_returnflag = 'R'"))
def line_mean_difference(spark, sf):
    return rounded(profile.mean_difference(X.table(spark, sf, "lineitem"), _LINE_NUMBERS, F.col("l_returnflag") == "R"))


_PAIRS = [(a, b) for a in S.OUTCOMES for b in S.OUTCOMES]


def _cooccurrence_sql(pairs, source):
    return " UNION ALL ".join(f"""
SELECT '{a}' AS given, '{b}' AS condition, exposed_n, cooccurring_n, round(base, 6) AS base_rate,
  round(cooccurring_n::DOUBLE / NULLIF(exposed_n, 0), 6) AS conditional_prevalence,
  round({O.wilson_low('cooccurring_n', 'exposed_n')}, 6) AS prevalence_ci_low,
  round({O.wilson_high('cooccurring_n', 'exposed_n')}, 6) AS prevalence_ci_high,
  round(cooccurring_n::DOUBLE / NULLIF(exposed_n, 0) / NULLIF(base, 0), 6) AS prevalence_lift
FROM (SELECT count(*) FILTER (WHERE {a} = 1) AS exposed_n, count(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS cooccurring_n,
  avg({b}) AS base FROM {source})""" for a, b in pairs)


@query("cooccurrence_lift", O.SURVEY + _cooccurrence_sql(_PAIRS, "survey"))
def cooccurrence_lift(spark, sf):
    return rounded(profile.cooccurrence(X.survey_clean(spark, sf), S.OUTCOMES))


_EVENT_FLAGS = ["error", "purchase", "signup"]


@query("user_event_lift", "WITH u AS (SELECT user_id, " + ", ".join(
    f"max(CASE WHEN event_type = '{t}' AND value > 100 THEN 1 ELSE 0 END) AS \"{t}\"" for t in _EVENT_FLAGS)
    + " FROM events GROUP BY user_id) " + _cooccurrence_sql([(a, b) for a in _EVENT_FLAGS for b in _EVENT_FLAGS], "u"))
def user_event_lift(spark, sf):
    users = X.table(spark, sf, "events").groupBy("user_id").agg(
        *[F.max(C.flag((F.col("event_type") == t) & (F.col("value") > 100))).alias(t) for t in _EVENT_FLAGS])
    return rounded(profile.cooccurrence(users, _EVENT_FLAGS))


@query("label_lift", "WITH l AS (SELECT * FROM labels) " + _cooccurrence_sql(
    [(a, b) for a in ("quality", "toxic") for b in ("quality", "toxic")], "l"))
def label_lift(spark, sf):
    return rounded(profile.cooccurrence(X.table(spark, sf, "labels"), ["quality", "toxic"]))


_WALD = "round({p} - 1.96 * sqrt({p} * (1 - {p}) / {n}), 6) AS ci_low, round({p} + 1.96 * sqrt({p} * (1 - {p}) / {n}), 6) AS ci_high"


@query("rate_by_category", O.ENCOUNTERS + f"""
SELECT diag_1_group, n, round(r, 6) AS rate, {_WALD.format(p='r', n='n')}
FROM (SELECT diag_1_group, count(*) AS n, avg(readmitted_30d) AS r FROM features GROUP BY 1 HAVING count(*) >= 100)""")
def rate_by_category(spark, sf):
    return rounded(profile.group_rates(X.cohort_features(spark, sf), "diag_1_group", OUTCOME, 100))


@query("disposition_rates", O.ENCOUNTERS + """
SELECT discharge_disposition_id, count(*) AS n, round(100.0 * avg(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END), 6) AS pct,
  discharge_disposition_id IN (11,19,20,13,14) AS flagged FROM typed GROUP BY 1 HAVING count(*) >= 30""")
def disposition_rates(spark, sf):
    raw = X.raw_encounters(spark, sf).select(
        F.col("discharge_disposition_id").cast("int").alias("discharge_disposition_id"),
        C.flag(F.col("readmitted") == "<30").alias("_y"))
    rates = profile.group_rates(raw, "discharge_disposition_id", "_y", 30)
    return rounded(rates.select("discharge_disposition_id", "n", (100.0 * F.col("rate")).alias("pct"),
                                F.col("discharge_disposition_id").isin(E.EXPIRED_OR_HOSPICE).alias("flagged")))


@query("income_gradient", O.SURVEY + f""",
g AS (SELECT income_band, count(*) AS n, avg(has_diabetes) AS r FROM survey GROUP BY 1)
SELECT income_band, n, round(r, 6) AS rate, {_WALD.format(p='r', n='n')},
  round((SELECT arg_min(r, income_band) FROM g) / NULLIF((SELECT arg_max(r, income_band) FROM g), 0), 6) AS first_to_last_ratio FROM g""")
def income_gradient(spark, sf):
    return rounded(profile.rate_gradient(X.survey_clean(spark, sf), "income_band", "has_diabetes"))


_EDGES = "quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])"


def _bins_sql(columns: list[str]) -> str:
    return f"""
v AS ({O.stacked(columns, 'features', extra='readmitted_30d AS y')}),
e AS (SELECT variable, list_distinct({_EDGES}) AS edges FROM v GROUP BY variable),
b AS (SELECT v.variable, greatest(len(list_filter(edges, lambda x: x < value)) - 1, 0) AS bin, y FROM v JOIN e ON v.variable = e.variable),
r AS (SELECT variable, bin, count(*) AS n, avg(y) AS r FROM b GROUP BY 1, 2)
"""


@query("rate_by_quantile_bin", O.ENCOUNTERS + "," + _bins_sql(COUNTS) + f"""
SELECT variable, CAST(bin AS INTEGER) AS bin, n, round(r, 6) AS rate, {_WALD.format(p='r', n='n')} FROM r""")
def rate_by_quantile_bin(spark, sf):
    return rounded(profile.quantile_bin_rates(X.cohort_table(spark, sf, OUTCOME, *COUNTS), COUNTS, OUTCOME))


_BINNED = ["number_diagnoses", "time_in_hospital", "num_medications", "num_lab_procedures", "num_procedures"]


@query("encoding_spread", O.ENCOUNTERS + "," + _bins_sql(_BINNED) + f"""
SELECT variable AS feature, count(*) || ' bins' AS encoding, round(100 * arg_min(r, bin), 6) AS low_pct,
  round(100 * arg_max(r, bin), 6) AS high_pct, round(100 * (max(r) - min(r)), 6) AS spread_pp FROM r GROUP BY variable
UNION ALL SELECT variable, 'binary (any vs none)', round(100 * avg(y) FILTER (WHERE value = 0), 6),
  round(100 * avg(y) FILTER (WHERE value > 0), 6), round(100 * (avg(y) FILTER (WHERE value > 0) - avg(y) FILTER (WHERE value = 0)), 6)
FROM ({O.stacked(E.PRIOR_VISITS, 'features', extra='readmitted_30d AS y')}) GROUP BY variable""")
def encoding_spread(spark, sf):
    return rounded(profile.encoding_spread(X.cohort_table(spark, sf, OUTCOME, *COUNTS), _BINNED, E.PRIOR_VISITS, OUTCOME))


@query("histogram_density", O.SURVEY + """
SELECT has_diabetes, CAST(k AS INTEGER) AS bin, CAST(12 + k AS DOUBLE) AS bin_low, count(*) AS n,
  round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY has_diabetes) AS DOUBLE), 6) AS density
FROM (SELECT has_diabetes, least(floor(bmi - 12), 48) AS k FROM survey WHERE bmi BETWEEN 12 AND 61) GROUP BY has_diabetes, k""")
def histogram_density(spark, sf):
    return rounded(profile.histogram(X.survey_clean(spark, sf), "bmi", 12.0, 1.0, 49, by="has_diabetes"))


@query("auto_histogram", """
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n
FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1""")
def auto_histogram(spark, sf):
    return profile.auto_histogram(X.table(spark, sf, "lineitem"), "l_extendedprice", 40)


@query("crosstab", """
SELECT l_linenumber, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N",
  count(*) FILTER (WHERE l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def crosstab(spark, sf):
    return profile.crosstab(X.table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"])


_RANKED = """, g AS (SELECT diag_1_group, readmitted, count(*) AS n FROM fact GROUP BY 1, 2)
"""


@query("pivot_rank", O.ENCOUNTERS + _RANKED + """
SELECT diag_1_group, max(CASE WHEN readmitted = 'NO' THEN rank END) AS "NO", max(CASE WHEN readmitted = '<30' THEN rank END) AS "<30",
  max(CASE WHEN readmitted = '>30' THEN rank END) AS ">30"
FROM (SELECT *, CAST(rank() OVER (PARTITION BY readmitted ORDER BY n DESC) AS INTEGER) AS rank FROM g) GROUP BY 1""")
def pivot_rank(spark, sf):
    counts = E.fact_columns(X.silver(spark, sf)).groupBy("diag_1_group", "readmitted").agg(F.count(F.lit(1)).alias("n"))
    ranked = profile.rank_within(counts, "readmitted", "n")
    return profile.pivot_first(ranked, "diag_1_group", "readmitted", ["NO", "<30", ">30"], "rank")


_LEVELS = ["NO", "<30", ">30"]


@query("rank_agreement", O.ENCOUNTERS + _RANKED + """,
k AS (SELECT *, rank() OVER (PARTITION BY readmitted ORDER BY n) + (count(*) OVER (PARTITION BY readmitted, n) - 1) / 2.0 AS r FROM g)
SELECT a.readmitted AS outcome_a, b.readmitted AS outcome_b, round(corr(a.r, b.r), 6) AS spearman_rank_correlation
FROM k a JOIN k b ON a.diag_1_group = b.diag_1_group
WHERE (a.readmitted, b.readmitted) IN (('NO', '<30'), ('NO', '>30'), ('<30', '>30')) GROUP BY 1, 2""")
def rank_agreement(spark, sf):
    counts = E.fact_columns(X.silver(spark, sf)).groupBy("diag_1_group", "readmitted").agg(F.count(F.lit(1)).alias("n"))
    return rounded(profile.rank_agreement(counts, "diag_1_group", "readmitted", "n", _LEVELS))


_PROFILE_SQL = ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in COUNTS)


@query("group_profile", O.ENCOUNTERS + f"""
SELECT age_band, n, events, round(events::DOUBLE / n, 6) AS event_rate, round({O.wilson_low('events', 'n')}, 6) AS ci_low,
  round({O.wilson_high('events', 'n')}, 6) AS ci_high, {', '.join('mean_' + c for c in COUNTS)}
FROM (SELECT age_band, count(*) AS n, CAST(sum(readmitted_30d) AS BIGINT) AS events, {_PROFILE_SQL} FROM features GROUP BY 1)""")
def group_profile(spark, sf):
    return rounded(profile.group_profile(X.cohort_features(spark, sf), "age_band", OUTCOME, COUNTS))


@query("unpivot_means", O.ENCOUNTERS + "SELECT age_band, feature, round(avg(value), 6) AS mean FROM ("
       + O.stacked(COUNTS, "features", "feature", "value", "age_band") + ") GROUP BY 1, 2")
def unpivot_means(spark, sf):
    return rounded(profile.unpivot_means(profile.group_profile(X.cohort_features(spark, sf), "age_band", OUTCOME, COUNTS), "age_band"))


@query("top_groups", O.ENCOUNTERS + """
SELECT diag_1_group, round(100.0 * avg(high_prior_utilizer), 6) AS pct FROM features GROUP BY 1 ORDER BY pct DESC, 1 LIMIT 5""")
def top_groups(spark, sf):
    return rounded(profile.top_groups(X.cohort_features(spark, sf), "diag_1_group", "high_prior_utilizer", 5))


@query("mean_and_sd", """
SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd
FROM lineitem GROUP BY 1, 2""")
def mean_and_sd(spark, sf):
    return rounded(profile.mean_and_sd(X.table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"], "l_quantity"))


# ---------------------------------------------------------------- statistics

FACTORS = ["a1c_tested", "any_med_adjusted", "a1c_tested_and_changed", "any_number_inpatient", "high_prior_utilizer",
           "is_hospice", "diag_1_group", "age_band", "race"]
RANKED = ["number_inpatient", "number_diagnoses", "time_in_hospital", "num_medications", "num_lab_procedures"]

_CHI_SQL = f""",
v AS ({O.stacked(FACTORS, 'features', 'factor', 'level', 'readmitted_30d AS y', 'VARCHAR')}),
lv AS (SELECT factor, level, count(*) AS r FROM v GROUP BY 1, 2),
co AS (SELECT factor, y, count(*) AS c FROM v GROUP BY 1, 2),
tot AS (SELECT factor, count(*) AS n, count(DISTINCT level) AS k, count(DISTINCT y) AS m FROM v GROUP BY 1),
ob AS (SELECT factor, level, y, count(*) AS o FROM v GROUP BY 1, 2, 3),
cell AS (SELECT lv.factor, tot.n, tot.k, tot.m, abs(coalesce(o, 0) - r * c / CAST(n AS DOUBLE)) AS gap, r * c / CAST(n AS DOUBLE) AS ex
  FROM lv JOIN co ON lv.factor = co.factor JOIN tot ON tot.factor = lv.factor
  LEFT JOIN ob ON ob.factor = lv.factor AND ob.level = lv.level AND ob.y = co.y),
chi AS (SELECT 'chi2: ' || factor AS test,
  sum(CASE WHEN (k - 1) * (m - 1) = 1 THEN pow(gap - least(gap, 0.5), 2) ELSE pow(gap, 2) END / ex) AS statistic,
  CAST(any_value((k - 1) * (m - 1)) AS INTEGER) AS dof,
  sqrt(sum(pow(gap, 2) / ex) / any_value(n) / (least(any_value(k), any_value(m)) - 1)) AS effect_size,
  any_value(n) AS n FROM cell GROUP BY factor)
"""
_MWU_SQL = f""",
w AS ({O.stacked(RANKED, 'features', extra='readmitted_30d AS y')}),
rk AS (SELECT variable, value, y, rank() OVER (PARTITION BY variable ORDER BY value)
    + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS r FROM w),
us AS (SELECT variable, count(*) AS n, CAST(sum(y) AS DOUBLE) AS n1, count(*) - CAST(sum(y) AS DOUBLE) AS n0,
    sum(CASE WHEN y = 1 THEN r ELSE 0 END) - CAST(sum(y) AS DOUBLE) * (CAST(sum(y) AS DOUBLE) + 1) / 2 AS u FROM rk GROUP BY variable),
ties AS (SELECT variable, sum(CAST(t AS DOUBLE) * t * t - t) AS s FROM
    (SELECT variable, value, count(*) AS t FROM w GROUP BY 1, 2) GROUP BY 1),
mwu AS (SELECT 'mannwhitneyu: ' || us.variable AS test, u AS statistic, abs(1 - 2 * u / (n1 * n0)) AS effect_size, n,
    (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * (n + 1 - s / (CAST(n AS DOUBLE) * (n - 1)))) AS z
    FROM us JOIN ties ON us.variable = ties.variable)
"""


@query("chi_square_family", O.ENCOUNTERS + _CHI_SQL + """
SELECT test, round(statistic, 6) AS statistic, dof, round(effect_size, 6) AS effect_size, n FROM chi""")
def chi_square_family(spark, sf):
    t = association.chi_square(X.cohort_table(spark, sf, OUTCOME, *FACTORS), FACTORS, OUTCOME)
    return rounded(t.drop("effect_name"))


@query("mann_whitney_family", O.ENCOUNTERS + _MWU_SQL + """
SELECT test, round(statistic, 4) AS statistic, round(effect_size, 4) AS effect_size, n, round(greatest(z, 0), 4) AS z FROM mwu""")
def mann_whitney_family(spark, sf):
    t = association.mann_whitney(X.cohort_features(spark, sf), RANKED, OUTCOME)
    return rounded(t.select("test", "statistic", "effect_size", "n", "z"), 4)


@query("test_family", O.ENCOUNTERS + _CHI_SQL.replace("WITH", "") + _MWU_SQL + f""",
tests AS (
  SELECT test, statistic, dof, effect_size, 'Cramer''s V' AS effect_name, n, statistic AS x, dof AS k FROM chi
  UNION ALL SELECT test, statistic, NULL::INTEGER, effect_size, 'rank-biserial', n, greatest(z, 0) * greatest(z, 0), 1 FROM mwu),
p AS (SELECT *, {O.chi2_tail("x", "k")} AS p_value FROM tests),
i AS (SELECT *, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS m FROM p),
a AS (SELECT x.test, least(1.0, min(y.p_value * y.m / y.i)) AS p_adj FROM i x JOIN i y ON y.i >= x.i GROUP BY 1)
SELECT test, round(statistic, 4) AS statistic, dof, round(effect_size, 4) AS effect_size, effect_name, n, round(p_value, 4) AS p_value,
  round(p_adj, 4) AS p_adj, p_adj < 0.05 AS significant_fdr_05 FROM p JOIN a USING (test)""")
def test_family(spark, sf):
    return rounded(association.test_family(X.cohort_table(spark, sf, OUTCOME, *FACTORS, *RANKED), FACTORS, RANKED, OUTCOME), 4)


test_family.__test__ = False


@query("bh_adjust", O.ENCOUNTERS + """,
g AS (SELECT diag_1_group, count(*) AS n, avg(readmitted_30d) AS r FROM features GROUP BY 1),
b AS (SELECT avg(readmitted_30d) AS base FROM features),
p AS (SELECT diag_1_group, round(exp(-0.717 * z - 0.416 * z * z), 9) AS p_value FROM (
  SELECT diag_1_group, abs(r - base) / sqrt(base * (1 - base) / n) AS z FROM g, b)),
i AS (SELECT *, row_number() OVER (ORDER BY p_value, diag_1_group) AS i, count(*) OVER () AS m FROM p),
a AS (SELECT x.diag_1_group, x.p_value, least(1.0, min(y.p_value * y.m / y.i)) AS p_adj
  FROM i x JOIN i y ON y.i >= x.i GROUP BY 1, 2)
SELECT diag_1_group, round(p_value, 6) AS p_value, round(p_adj, 6) AS p_adj, p_adj < 0.05 AS significant_fdr_05 FROM a""")
def bh_adjust(spark, sf):
    df = X.cohort_table(spark, sf, OUTCOME, "diag_1_group")
    base = df.agg(F.avg(OUTCOME)).scalar()
    z = F.abs(F.col("rate") - F.col("base")) / F.sqrt(F.col("base") * (1 - F.col("base")) / F.col("n"))
    p = profile.group_rates(df, "diag_1_group", OUTCOME).withColumn("base", base).withColumn("z", z).select(
        "diag_1_group", F.round(F.exp(-0.717 * F.col("z") - 0.416 * F.col("z") * F.col("z")), 9).alias("p_value"))
    return rounded(association.adjust_fdr(p))


_CORR = [c for c in E.NUMERIC]


@query("spearman_matrix", O.ENCOUNTERS + ", ranks AS (SELECT patient_nbr, " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _CORR) + " FROM features) "
    + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS rho FROM ranks"
                         for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def spearman_matrix(spark, sf):
    return rounded(correlation.spearman(X.cohort_table(spark, sf, *_CORR), _CORR))


@query("variance_inflation")
def variance_inflation(spark, sf):
    return rounded(correlation.variance_inflation(X.cohort_table(spark, sf, *_CORR), _CORR))


@query("poisson_negbin", O.ENCOUNTERS + """,
m AS (SELECT count(*) AS n, avg(num_lab_procedures) AS m, var_samp(num_lab_procedures) AS v FROM features),
k AS (SELECT *, m * m / greatest(v - m, 1e-9) AS r FROM m),
l AS (SELECT any_value(n) AS n, any_value(m) AS m, any_value(v) AS v, any_value(r) AS r,
  sum(x * ln(m) - m - lgamma(x + 1)) AS lp,
  sum(lgamma(x + r) - lgamma(r) - lgamma(x + 1) + r * ln(r / (r + m)) + x * ln(1 - r / (r + m))) AS lb
  FROM (SELECT CAST(num_lab_procedures AS DOUBLE) AS x FROM features), k)
SELECT n, round(m, 4) AS mean, round(v, 4) AS variance, round(v / m, 4) AS dispersion_ratio, round(r, 4) AS nb_dispersion_r,
  round(lp, 3) AS loglik_poisson, round(lb, 3) AS loglik_negbin, round(2 * (lb - lp), 3) AS lr_statistic,
  round(0.5 * p, 6) AS p_value, round(2 - 2 * lp, 3) AS aic_poisson, round(4 - 2 * lb, 3) AS aic_negbin
FROM (SELECT *, """ + O.chi2_tail("2 * (lb - lp)", "1") + """ AS p FROM l)""")
def poisson_negbin(spark, sf):
    t = distributions.poisson_vs_negbin(X.cohort_table(spark, sf, "num_lab_procedures"), "num_lab_procedures")
    digits = {"mean": 4, "variance": 4, "dispersion_ratio": 4, "nb_dispersion_r": 4, "p_value": 6}
    return t.select("n", *[F.round(c, digits.get(c, 3)).alias(c) for c in t.columns if c != "n"])


@query("continuous_fits")
def continuous_fits(spark, sf):
    return rounded(distributions.continuous_fits(X.table(spark, sf, "lineitem"), "l_extendedprice"), 4)


@query("adjusted_rand", """
WITH p AS (SELECT CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 30 THEN 1 ELSE 2 END AS a,
    CASE WHEN p_retailprice <= 1200 THEN 0 ELSE 1 END AS b FROM part),
c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM c),
ra AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)),
rb AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((s - ra.v * rb.v / (n * (n - 1) / 2.0)) / ((ra.v + rb.v) / 2 - ra.v * rb.v / (n * (n - 1) / 2.0)), 6)
  AS adjusted_rand_index FROM s, ra, rb""")
def adjusted_rand(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    part = X.table(spark, sf, "part").select(
        F.when(size <= 10, 0).when(size <= 30, 1).otherwise(2).alias("a"), F.when(price <= 1200, 0).otherwise(1).alias("b"))
    return rounded(phenotypes.rand_index(part, "a", "b"))


# ---------------------------------------------------------------- encoding

@query("infrequent_levels", f"""
SELECT feature, level, n, CASE WHEN n >= 100 THEN level ELSE '{encode.RARE}' END AS encoded FROM (
  SELECT 'p_brand' AS feature, p_brand AS level, count(*) AS n FROM part GROUP BY 2
  UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)""")
def infrequent_levels(spark, sf):
    return encode.pooled_levels(X.table(spark, sf, "part"), ["p_brand", "p_type"], 100)


@query("standardized_features", O.ENCOUNTERS + "SELECT patient_nbr, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS num__{c}" for c in COUNTS) + " FROM features")
def standardized_features(spark, sf):
    df = X.cohort_table(spark, sf, "patient_nbr", *COUNTS)
    model = encode.FeatureEncoder(COUNTS, [], []).fit(df)
    return rounded(df.select("patient_nbr", *[e.alias(n) for n, e in model.columns().items()]))


_OH = ["diag_1_group", "gender", "admission_type_id"]


@query("one_hot_pooled", O.ENCOUNTERS + f"""
SELECT 'cat__' || feature || '_' || encoded AS encoded_feature, CAST(sum(n) AS DOUBLE) AS total FROM (
SELECT feature, n, CASE WHEN n >= 100 THEN level ELSE '{encode.RARE}' END AS encoded FROM (
  SELECT feature, level, count(*) AS n FROM ({O.stacked(_OH, 'features', 'feature', 'level', cast='VARCHAR')}) GROUP BY 1, 2))
GROUP BY 1""")
def one_hot_pooled(spark, sf):
    df = X.cohort_table(spark, sf, *_OH)
    cols = encode.FeatureEncoder([], [], _OH, min_count=100).fit(df).columns()
    return df.agg(*[F.sum(e).alias(n) for n, e in cols.items()]).unpivot([], list(cols), "encoded_feature", "total")


@query("design_matrix", O.SURVEY + """
SELECT term, CAST(sum(n) AS DOUBLE) AS total FROM (
  SELECT 'age_band_' || age_band AS term, count(*) AS n FROM survey WHERE age_band > (SELECT min(age_band) FROM survey) GROUP BY age_band
  UNION ALL SELECT 'sex', sum(sex) FROM survey) GROUP BY term""")
def design_matrix(spark, sf):
    wide, terms = encode.design_columns(X.survey_clean(spark, sf), S.DEMOGRAPHIC, S.CATEGORICAL)
    sums = wide.agg(*[F.sum(f"`x_{t}`").alias(t) for t in terms])
    return sums.unpivot([], terms, "term", "total")


_PHI = {
    "num__time_in_hospital": "0.02 * (time_in_hospital - 4)",
    "num__number_inpatient": "0.05 * (number_inpatient - 4)",
    "cat__gender_Male": "CASE WHEN gender = 'Male' THEN 0.3 ELSE -0.1 END",
    "cat__gender_Female": "CASE WHEN gender = 'Female' THEN -0.2 ELSE 0.25 END",
    "cat__a1c_result_Missing": "CASE WHEN a1c_result = 'Missing' THEN 0.4 ELSE -0.15 END",
    "cat__a1c_result_>8": "CASE WHEN a1c_result = '>8' THEN 0.1 ELSE -0.02 END",
}
_PHI_SQL = ", phi AS (" + " UNION ALL ".join(
    f"SELECT patient_nbr, '{n}' AS encoded_feature, CAST({sql} AS DOUBLE) AS phi FROM features" for n, sql in _PHI.items()) + ") "
_SRC_SQL = ("CASE WHEN encoded_feature LIKE 'cat\\__gender%' ESCAPE '\\' THEN 'gender' WHEN encoded_feature LIKE 'cat\\__a1c%' ESCAPE '\\' "
            "THEN 'a1c_result' ELSE substr(encoded_feature, 6) END")


def _contributions(spark, sf):
    values = [F.struct(F.lit(n).alias("encoded_feature"), F.expr(e).cast("double").alias("phi")) for n, e in _PHI.items()]
    return X.cohort_features(spark, sf).select("patient_nbr", F.inline(F.array(*values)))


@query("encoded_contributions", O.ENCOUNTERS + _PHI_SQL + f"""
SELECT encoded_feature, {_SRC_SQL} AS source_feature, round(a, 6) AS mean_abs_shap, row_number() OVER (ORDER BY a DESC) AS rank
FROM (SELECT encoded_feature, avg(abs(phi)) AS a FROM phi GROUP BY 1)""")
def encoded_contributions(spark, sf):
    return rounded(encoded_importance(_contributions(spark, sf), E.CATEGORICAL))


@query("source_contributions", O.ENCOUNTERS + _PHI_SQL + f"""
SELECT source_feature, round(a, 6) AS mean_abs_shap, round(100 * a / sum(a) OVER (), 6) AS importance_pct,
  row_number() OVER (ORDER BY a DESC) AS rank FROM (
  SELECT source_feature, avg(abs(s)) AS a FROM (
    SELECT patient_nbr, {_SRC_SQL} AS source_feature, sum(phi) AS s FROM phi GROUP BY 1, 2) GROUP BY 1)""")
def source_contributions(spark, sf):
    return rounded(source_importance(_contributions(spark, sf), "patient_nbr", E.CATEGORICAL))


# ---------------------------------------------------------------- evaluation

_AP_SQL = """,
h AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY 1, 2),
w AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(neg) OVER a - neg AS below,
  sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn FROM h
  WINDOW d AS (PARTITION BY model ORDER BY p DESC), a AS (PARTITION BY model ORDER BY p)),
ap AS (SELECT model, CAST(any_value(np + nn) AS BIGINT) AS n, CAST(any_value(np) AS BIGINT) AS events,
  sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / CAST(any_value(np) AS DOUBLE) AS ap,
  sum(pos * (below + neg / 2.0)) / CAST(any_value(np) * any_value(nn) AS DOUBLE) AS auc FROM w GROUP BY model)
"""


@query("discrimination", O.ENCOUNTERS + _AP_SQL + """
SELECT model, n, events, round(events::DOUBLE / n, 6) AS prevalence, round(ap, 6) AS pr_auc, round(auc, 6) AS roc_auc,
  round(ap / (events::DOUBLE / n), 6) AS lift FROM ap
UNION ALL SELECT 'prevalence', count(*), CAST(sum(readmitted_30d) AS BIGINT), round(avg(readmitted_30d), 6),
  round(avg(readmitted_30d), 6), 0.5, 1.0 FROM scored""")
def discrimination(spark, sf):
    return rounded(evaluation.discrimination(X.scored_cohort(spark, sf), OUTCOME, X.SCORES))


@query("line_return_ranking", """
WITH h AS (SELECT l_extendedprice AS p, sum(y) AS pos, sum(1 - y) AS neg FROM (
  SELECT l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) GROUP BY 1),
w AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
  sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM h)
SELECT 'l_extendedprice' AS model, CAST(any_value(np + nn) AS BIGINT) AS n, CAST(any_value(np) AS BIGINT) AS events,
  round(sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / CAST(any_value(np) AS DOUBLE), 6) AS pr_auc,
  round(sum(pos * (below + neg / 2.0)) / (CAST(any_value(np) AS DOUBLE) * any_value(nn)), 6) AS roc_auc FROM w""")
def line_return_ranking(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(C.flag(F.col("l_returnflag") == "R").alias("y"), "l_extendedprice")
    table = evaluation.rank_metrics(evaluation.long_scores(lines, "y", ["l_extendedprice"]), "y", ["model"])
    return rounded(table.select("model", "n", "events", "pr_auc", "roc_auc"))


@query("brier_scores", O.ENCOUNTERS + """
SELECT model, count(*) AS n, round(avg(y), 6) AS event_rate, round(avg((p - y) * (p - y)), 6) AS brier_score
FROM scores WHERE model <> 'rule_baseline' GROUP BY model""")
def brier_scores(spark, sf):
    return rounded(evaluation.brier(X.scored_cohort(spark, sf), OUTCOME, ["score_a", "score_b"]))


_METRICS = """flagged AS flagged_n, round(flagged::DOUBLE / n, 6) AS flagged_pct, tp, fp, tn, fn,
  round(coalesce(tp::DOUBLE / NULLIF(tp + fn, 0), 0), 6) AS sensitivity_recall, round(tn::DOUBLE / NULLIF(tn + fp, 0), 6) AS specificity,
  round(coalesce(tp::DOUBLE / NULLIF(flagged, 0), 0), 6) AS ppv_precision, round(tn::DOUBLE / NULLIF(tn + fn, 0), 6) AS npv,
  round(coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((coalesce(tp::DOUBLE / NULLIF(tp + fn, 0), 0) + tn::DOUBLE / NULLIF(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / NULLIF(sqrt(flagged::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
  round((tp + tn)::DOUBLE / n, 6) AS accuracy, round(100.0 * tp / NULLIF(tp + fn, 0), 6) AS event_capture_pct"""
_COUNTED = """count(*) AS n, count(*) FILTER (WHERE p >= t) AS flagged, count(*) FILTER (WHERE p >= t AND y = 1) AS tp,
  count(*) FILTER (WHERE p >= t AND y = 0) AS fp, count(*) FILTER (WHERE p < t AND y = 0) AS tn,
  count(*) FILTER (WHERE p < t AND y = 1) AS fn"""


@query("threshold_table", O.ENCOUNTERS + f"""
SELECT 'probability' AS rule, CAST(t AS DOUBLE) AS threshold, {_METRICS} FROM (
  SELECT t, {_COUNTED} FROM (SELECT * FROM scores WHERE model = 'score_a'),
    (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.15), (0.2), (0.25)) AS v(t) GROUP BY t)""")
def threshold_table(spark, sf):
    return rounded(evaluation.threshold_table(X.scored_cohort(spark, sf), OUTCOME, "score_a"))


@query("top_fraction_table", O.ENCOUNTERS + f""",
s AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM scores WHERE model = 'score_a'),
f AS (SELECT fr, s.p AS t FROM (VALUES (0.05), (0.10), (0.20)) AS v(fr) JOIN s ON s.i = ceil((n - 1) * (1 - fr)))
SELECT 'top_' || CAST(round(100 * fr) AS INTEGER) || 'pct_risk' AS rule, t AS threshold, {_METRICS},
  CAST(100 * fr AS DOUBLE) AS target_flagged_pct FROM (
  SELECT fr, t, {_COUNTED} FROM (SELECT y, p FROM s), f GROUP BY fr, t)""")
def top_fraction_table(spark, sf):
    return rounded(evaluation.top_fraction_table(X.scored_cohort(spark, sf), OUTCOME, "score_a"))


_REL_SQL = """,
cl AS (SELECT model, y, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM scores WHERE model <> 'rule_baseline'),
ed AS (SELECT model, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM cl GROUP BY model),
bn AS (SELECT cl.model, len(list_filter(e, lambda x: x < p)) AS b, p, y FROM cl JOIN ed ON cl.model = ed.model),
rel AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY b) AS bin, n_bin, mp, o FROM (
  SELECT model, b, count(*) AS n_bin, avg(p) AS mp, avg(y) AS o FROM bn GROUP BY 1, 2))
"""


def with_sums(bins: DataFrame) -> DataFrame:
    """Sums in place of mean predictions: scores have six digits, so a sum of them has too and no tie is left to round."""
    return bins.withColumn("mean_predicted_probability", F.col("mean_predicted_probability") * F.col("n_bin")).withColumnRenamed(
        "mean_predicted_probability", "predicted_sum")


@query("reliability_bins", O.ENCOUNTERS + _REL_SQL + """
SELECT model, bin, n_bin, round(mp * n_bin, 6) AS predicted_sum, round(o, 6) AS observed_event_rate FROM rel""")
def reliability_bins(spark, sf):
    return rounded(with_sums(evaluation.reliability_bins(X.scored_table(spark, sf, OUTCOME, "score_a", "score_b"), OUTCOME, ["score_a", "score_b"])))


@query("calibration_report", O.ENCOUNTERS + _REL_SQL + """,
sm AS (SELECT model, count(*) AS n, avg(y) AS er, avg((p - y) * (p - y)) AS br FROM scores WHERE model <> 'rule_baseline' GROUP BY 1)
SELECT rel.model, bin, n_bin, round(mp * n_bin, 6) AS predicted_sum, round(o, 6) AS observed_event_rate,
  n, round(er, 6) AS event_rate, round(br, 6) AS brier_score FROM rel LEFT JOIN sm ON rel.model = sm.model""")
def calibration_report(spark, sf):
    df = X.scored_table(spark, sf, OUTCOME, "score_a", "score_b")
    models = ["score_a", "score_b"]
    return rounded(evaluation.calibration_report(
        with_sums(evaluation.reliability_bins(df, OUTCOME, models)), evaluation.brier(df, OUTCOME, models)))


_AUDIT_SQL = f""",
g AS ({' UNION ALL '.join(f"SELECT '{a}' AS attribute, coalesce({a}, 'Missing') AS grp, readmitted_30d AS y, score_a AS p FROM scored" for a in ATTRIBUTES)}),
au AS (SELECT attribute, grp, t, count(*) AS n, count(*) FILTER (WHERE y = 1) AS ev, count(*) FILTER (WHERE y = 0) AS ne,
  count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp
  FROM g, (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.15), (0.2), (0.25)) AS v(t) GROUP BY 1, 2, 3)
"""


@query("fairness_audit", O.ENCOUNTERS + _AUDIT_SQL + f"""
SELECT 'score_a' AS model, attribute, grp AS "group", t AS threshold, n, ev AS events, ne AS non_events, tp, fp,
  ne - fp AS tn, ev - tp AS fn, tp + fp AS flagged_n, round((tp + fp)::DOUBLE / n, 6) AS flagged_rate,
  ev < 20 AS small_event_count, ne < 20 AS small_non_event_count,
  round(tp::DOUBLE / NULLIF(ev, 0), 6) AS tpr, round({O.wilson_low('tp', 'ev')}, 6) AS tpr_ci_low,
  round({O.wilson_high('tp', 'ev')}, 6) AS tpr_ci_high, round(fp::DOUBLE / NULLIF(ne, 0), 6) AS fpr,
  round({O.wilson_low('fp', 'ne')}, 6) AS fpr_ci_low, round({O.wilson_high('fp', 'ne')}, 6) AS fpr_ci_high FROM au""")
def fairness_audit(spark, sf):
    return rounded(evaluation.subgroup_audit(X.scored_cohort(spark, sf), OUTCOME, "score_a", ATTRIBUTES))


def _gap_sql(metric: str, k: str, n: str) -> str:
    return f"""
SELECT attribute, t AS threshold, '{metric}' AS metric, count(*) FILTER (WHERE {n} >= 20) AS eligible_groups,
  CAST(20 AS INTEGER) AS minimum_denominator,
  CASE WHEN count(*) FILTER (WHERE {n} >= 20) >= 2 THEN round(max({k}::DOUBLE / {n}) FILTER (WHERE {n} >= 20)
    - min({k}::DOUBLE / {n}) FILTER (WHERE {n} >= 20), 6) END AS max_minus_min,
  CASE WHEN count(*) FILTER (WHERE {n} >= 20) >= 2 THEN (list(grp ORDER BY {k}::DOUBLE / {n} DESC, grp) FILTER (WHERE {n} >= 20))[1] END AS highest_group,
  CASE WHEN count(*) FILTER (WHERE {n} >= 20) >= 2 THEN (list(grp ORDER BY {k}::DOUBLE / {n}, grp) FILTER (WHERE {n} >= 20))[1] END AS lowest_group
FROM au GROUP BY 1, 2"""


@query("fairness_gaps", O.ENCOUNTERS + _AUDIT_SQL + _gap_sql("tpr", "tp", "NULLIF(ev, 0)") + " UNION ALL "
       + _gap_sql("fpr", "fp", "NULLIF(ne, 0)"))
def fairness_gaps(spark, sf):
    return rounded(evaluation.gap_table(
        evaluation.subgroup_audit(X.scored_cohort(spark, sf), OUTCOME, "score_a", ATTRIBUTES)))


@query("rate_by_group", O.ENCOUNTERS + f"""
SELECT diag_1_group, n, events, round(events::DOUBLE / n, 6) AS rate, round({O.wilson_low('events', 'n')}, 6) AS ci_low,
  round({O.wilson_high('events', 'n')}, 6) AS ci_high
FROM (SELECT diag_1_group, count(*) AS n, CAST(sum(readmitted_30d) AS BIGINT) AS events FROM features GROUP BY 1)""")
def rate_by_group(spark, sf):
    """Flagship: clean, exclude, take first events, rate per code group."""
    g = profile.group_profile(E.first_cohort(X.silver(spark, sf)), "diag_1_group", OUTCOME, [])
    return rounded(g.withColumnRenamed("event_rate", "rate"))


