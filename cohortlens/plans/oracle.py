"""Reference SQL for the registered queries: shared common table expressions.

Written separately from the DataFrame code, in the most literal form (self joins, window frames,
one scan per metric), to compare whole results with.
"""

from __future__ import annotations

from cohortlens.plans.encounters import CATEGORICAL, DRUGS, INT_COLUMNS, UTILIZATION
from cohortlens.plans.fixtures import drug_slots

_Q = [f'"{d}"' for d in DRUGS]
_MAX = ",\n    ".join(
    f"max(CASE WHEN l_linenumber = {n} AND l_returnflag = '{r}' THEN l_discount END) AS d_{n}{r}"
    for _, n, r in drug_slots())
_TEXT = ",\n    ".join(
    f"CASE WHEN d_{n}{r} IS NULL THEN 'No' WHEN d_{n}{r} >= 0.09 THEN 'Up' "
    f"WHEN d_{n}{r} <= 0.01 THEN 'Down' ELSE 'Steady' END AS \"{drug}\"" for drug, n, r in drug_slots())
_ACTIVE = " + ".join(f"CASE WHEN {q} = 'No' THEN 0 ELSE 1 END" for q in _Q)
_ADJUSTED = " OR ".join(f"coalesce({q} IN ('Up','Down'), false)" for q in _Q)
_CODE_RANGES = """(1, 139, 'infectious'), (140, 239, 'neoplasms'), (240, 279, 'endocrine_other'), (290, 319, 'mental'),
  (320, 389, 'nervous_sensory'), (390, 459, 'circulatory'), (460, 519, 'respiratory'), (520, 579, 'digestive'),
  (580, 629, 'genitourinary'), (710, 739, 'musculoskeletal'), (800, 999, 'injury')"""

# How a raw text column becomes a clean one, by rule, and the names that change.
_RULES = {
    "{c}::BIGINT": ["encounter_id", "patient_nbr"],
    "{c}::INTEGER": INT_COLUMNS,
    "nullif({c}, '?')": ["diag_1", "diag_2", "diag_3", "medical_specialty", "payer_code", "race"],
    "nullif({c}, 'None')": ["a1c_result", "max_glu_serum"],
    "list_extract(list_intersect([{c}], ['Female', 'Male']), 1)": ["gender"],
}
_NAMES = {"A1Cresult": "a1c_result", "age": "age_band", "change": "med_change", "diabetesMed": "on_diabetes_med"}
_INDICATORS = {"readmitted_30d": "readmitted = '<30'", "a1c_tested": "a1c_result IS NOT NULL", "med_changed": "med_change = 'Ch'"}
_EXPIRED, _HOSPICE = [11, 19, 20], [13, 14]

_CLEANED = ", ".join(rule.format(c=f'"{c}"') + f' AS "{c}"' for rule, columns in _RULES.items() for c in columns)
_RENAMED = ", ".join(f'"{old}" AS {new}' for old, new in _NAMES.items())

ENCOUNTERS = f"""
WITH lines AS (
  SELECT l_orderkey, count(*) AS n_lines, CAST(sum(l_quantity) AS INTEGER) AS qty,
    count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(*) FILTER (WHERE l_quantity > 20) AS n_bulk,
    count(*) FILTER (WHERE l_discount >= 0.1) AS n_deep, count(*) FILTER (WHERE l_tax >= 0.08) AS n_taxed,
    count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, max(l_discount) AS max_discount,
    {_MAX}
  FROM lineitem GROUP BY l_orderkey
),
seqd AS (
  SELECT *, row_number() OVER w AS seq, lead(o_orderdate) OVER w AS next_date
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
),
joined AS (
  SELECT s.*, c.c_mktsegment, c.c_acctbal, c.c_nationkey, l.*,
    coalesce(l.n_lines, 0) AS nl, coalesce(l.qty, 0) AS q, coalesce(l.n_returned, 0) AS nr,
    CAST(CAST(floor(o_totalprice / 500) AS INTEGER) AS VARCHAR) AS k,
    10 * CAST(floor(c_nationkey / 2.5) AS INTEGER) AS decade
  FROM seqd s LEFT JOIN lines l ON s.o_orderkey = l.l_orderkey LEFT JOIN customer c ON s.o_custkey = c.c_custkey
),
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id, CAST(o_custkey AS VARCHAR) AS patient_nbr,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '?' ELSE c_mktsegment END AS race,
    CASE WHEN c_acctbal < -900 THEN 'Unknown/Invalid' WHEN c_acctbal < 4500 THEN 'Female' ELSE 'Male' END AS gender,
    '[' || decade || '-' || (decade + 10) || ')' AS age,
    substr(o_orderpriority, 1, 1) AS admission_type_id,
    CAST(CASE WHEN o_orderstatus = 'P' THEN
        CASE WHEN o_totalprice >= 492000 THEN 11 WHEN o_totalprice >= 489000 THEN 19 WHEN o_totalprice >= 487000 THEN 20
             WHEN o_totalprice >= 470000 THEN 13 WHEN o_totalprice >= 455000 THEN 14 WHEN o_totalprice >= 430000 THEN 7
             WHEN o_totalprice >= 420000 THEN 9 WHEN o_totalprice >= 415000 THEN 99 ELSE 1 END
      WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 6 ELSE 1 END
      ELSE CASE o_orderpriority WHEN '5-LOW' THEN 18 WHEN '4-NOT SPECIFIED' THEN 22 WHEN '3-MEDIUM' THEN 2 ELSE 1 END
      END AS VARCHAR) AS discharge_disposition_id,
    CAST(month(o_orderdate) AS VARCHAR) AS admission_source_id, CAST(nl AS VARCHAR) AS time_in_hospital,
    CAST(q AS VARCHAR) AS num_lab_procedures, CAST(nr AS VARCHAR) AS num_procedures,
    CAST(coalesce(n_bulk, 0) AS VARCHAR) AS num_medications, CAST(coalesce(n_deep, 0) AS VARCHAR) AS number_outpatient,
    CAST(coalesce(n_taxed, 0) AS VARCHAR) AS number_emergency, CAST(seq - 1 AS VARCHAR) AS number_inpatient,
    CAST(coalesce(n_open, 0) + 1 AS VARCHAR) AS number_diagnoses,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '?' ELSE o_orderpriority END AS medical_specialty,
    CASE WHEN c_nationkey < 5 THEN '?' ELSE CAST(c_nationkey AS VARCHAR) END AS payer_code,
    CASE WHEN nl = 0 THEN '?' WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'V' || k
      WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'E' || k
      ELSE k || '.' || least(nl, 9) END AS diag_1,
    CASE WHEN nl < 2 THEN '?' ELSE k END AS diag_2, CASE WHEN nl < 3 THEN '?' ELSE k END AS diag_3,
    CASE WHEN q < 50 THEN 'None' WHEN q < 100 THEN 'Norm' WHEN q < 150 THEN '>200' ELSE '>300' END AS max_glu_serum,
    CASE WHEN max_discount >= 0.09 THEN '>8' WHEN max_discount >= 0.07 THEN '>7' WHEN max_discount >= 0.05 THEN 'Norm'
      ELSE 'None' END AS "A1Cresult",
    {_TEXT},
    CASE WHEN nr > 0 THEN 'Ch' ELSE 'No' END AS "change", CASE WHEN nl > 0 THEN 'Yes' ELSE 'No' END AS "diabetesMed",
    CASE WHEN next_date IS NULL THEN 'NO' WHEN next_date <= o_orderdate + INTERVAL 30 DAY THEN '<30' ELSE '>30' END
      AS readmitted
  FROM joined
),
typed AS (
  SELECT * REPLACE ({_CLEANED}) FROM (SELECT * RENAME ({_RENAMED}) FROM raw)
),
span AS (
  SELECT patient_nbr, max(encounter_id) AS last_id,
    min(encounter_id) FILTER (WHERE list_contains({_EXPIRED}, discharge_disposition_id)) AS first_absorbing_id
  FROM typed GROUP BY patient_nbr
),
post_expired AS (
  -- an event after an absorbing one: the first absorbing id lies before the last id
  SELECT patient_nbr FROM span WHERE last_id > first_absorbing_id
),
silver AS (
  SELECT typed.*, list_contains({_EXPIRED}, discharge_disposition_id) AS is_expired, list_contains({_HOSPICE}, discharge_disposition_id) AS is_hospice,
    {", ".join(f"coalesce({rule}, false)::INTEGER AS {name}" for name, rule in _INDICATORS.items())}
  FROM typed JOIN span USING (patient_nbr)
  WHERE gender IS NOT NULL AND coalesce(last_id <= first_absorbing_id, true) AND NOT coalesce(list_contains({_EXPIRED}, discharge_disposition_id), true)
),
code_ranges(low, high, grp) AS (VALUES
  -- fixed values: inclusive bounds of the code groups
  {_CODE_RANGES}
),
coded AS (
  SELECT encounter_id, left(diag_1, 1) AS prefix, TRY_CAST(diag_1 AS DOUBLE) AS number FROM silver WHERE diag_1 IS NOT NULL
),
ranged AS (
  -- 250 up to 251 lies inside a wider range and has a group of its own
  SELECT encounter_id, CASE WHEN prefix IN ('V', 'E') THEN 'supplementary' WHEN number >= 250 AND number < 251 THEN 'diabetes'
    ELSE coalesce(grp, 'other') END AS grp
  FROM coded LEFT JOIN code_ranges ON number >= low AND number <= high
),
visits AS (
  SELECT patient_nbr, list_sort(list(encounter_id)) AS ids FROM silver GROUP BY patient_nbr
),
fact AS (
  SELECT silver.*, coalesce(grp, 'unknown') AS diag_1_group,
    TRY_CAST(split_part(substr(age_band, 2), '-', 1) AS INTEGER) + 5 AS age_midpoint,
    number_inpatient + number_emergency + number_outpatient AS prior_visits_total,
    CAST(list_position(ids, encounter_id) AS BIGINT) AS encounter_seq, CAST(len(ids) AS BIGINT) AS patient_encounter_count
  FROM silver JOIN visits USING (patient_nbr) LEFT JOIN ranged USING (encounter_id)
),
features AS (
  SELECT * EXCLUDE (race, medical_specialty, payer_code, max_glu_serum, a1c_result, is_hospice),
    coalesce(race, 'Missing') AS race, coalesce(medical_specialty, 'Missing') AS medical_specialty,
    coalesce(payer_code, 'Missing') AS payer_code, coalesce(max_glu_serum, 'Missing') AS max_glu_serum,
    coalesce(a1c_result, 'Missing') AS a1c_result, CAST(is_hospice AS INTEGER) AS is_hospice,
    {_ACTIVE} AS n_active_diabetes_meds,
    CASE WHEN {_ADJUSTED} THEN 1 ELSE 0 END AS any_med_adjusted,
    num_procedures / CAST(greatest(time_in_hospital, 1) AS DOUBLE) AS procedures_per_day,
    num_medications / CAST(greatest(time_in_hospital, 1) AS DOUBLE) AS meds_per_day,
    num_lab_procedures / CAST(greatest(time_in_hospital, 1) AS DOUBLE) AS labs_per_day,
    ln(1 + number_inpatient) AS log_number_inpatient, ln(1 + number_emergency) AS log_number_emergency,
    ln(1 + number_outpatient) AS log_number_outpatient,
    CAST(number_inpatient > 0 AS INTEGER) AS any_number_inpatient,
    CAST(number_emergency > 0 AS INTEGER) AS any_number_emergency,
    CAST(number_outpatient > 0 AS INTEGER) AS any_number_outpatient,
    CAST(number_inpatient >= 2 AS INTEGER) AS high_prior_utilizer,
    a1c_tested * CASE WHEN {_ADJUSTED} THEN 1 ELSE 0 END AS a1c_tested_and_changed
  FROM fact WHERE encounter_seq = 1
),
scored AS (
  SELECT *, CAST(number_inpatient AS DOUBLE) AS rule_baseline,
    round(1.0 / (1.0 + exp(-(0.08 * number_inpatient + 0.05 * time_in_hospital - 2.5))), 6) AS score_a,
    round(1.0 / (1.0 + exp(-(0.01 * num_lab_procedures - 0.1 * num_procedures - 2.2))), 6) AS score_b
  FROM features
),
scores AS (
  SELECT patient_nbr, readmitted_30d AS y, 'rule_baseline' AS model, rule_baseline AS p FROM scored
  UNION ALL SELECT patient_nbr, readmitted_30d, 'score_a', score_a FROM scored
  UNION ALL SELECT patient_nbr, readmitted_30d, 'score_b', score_b FROM scored
)
"""

SURVEY = """
WITH history AS (
  SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u,
    count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS h, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS m,
    count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS l, count(*) FILTER (WHERE year(o_orderdate) < 1997) AS early,
    count(*) FILTER (WHERE year(o_orderdate) >= 2000) AS late,
    count(*) FILTER (WHERE month(o_orderdate) IN (12, 1, 2)) AS w, max(o_totalprice) AS mx, min(o_totalprice) AS mn
  FROM orders GROUP BY o_custkey
),
c AS (
  SELECT customer.*, coalesce(n, 0) AS n, coalesce(f, 0) AS f, coalesce(p, 0) AS p, coalesce(u, 0) AS u,
    coalesce(h, 0) AS h, coalesce(m, 0) AS m, coalesce(l, 0) AS l, coalesce(early, 0) AS early,
    coalesce(late, 0) AS late, coalesce(w, 0) AS w, coalesce(mx, 0) AS mx, coalesce(mn, 0) AS mn
  FROM customer LEFT JOIN history ON c_custkey = o_custkey
),
survey AS (
  SELECT c_custkey AS row_id, CAST(f >= 5 AS TINYINT) AS has_diabetes, CAST(u >= 4 AS TINYINT) AS has_stroke,
    CAST(mx > 492000 AS TINYINT) AS has_cardiac, CAST(12 + floor(mn / 10000) AS DOUBLE) AS bmi,
    CAST(n >= 10 AS TINYINT) AS high_bp, CAST(p >= 4 AS TINYINT) AS high_chol, CAST(m + l >= 2 AS TINYINT) AS chol_checked,
    CAST(c_acctbal < 1000 AS TINYINT) AS smoker, CAST(late >= 3 AS TINYINT) AS phys_activity,
    CAST(l >= 2 AS TINYINT) AS eats_fruit, CAST(m >= 2 AS TINYINT) AS eats_veg, CAST(w >= 5 AS TINYINT) AS heavy_alcohol,
    CAST(mn < 60000 AS TINYINT) AS has_coverage, CAST(c_acctbal < 0 AS TINYINT) AS skipped_care_cost,
    CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3
      WHEN 'FURNITURE' THEN 4 ELSE 5 END AS TINYINT) AS gen_health,
    CAST(least(30, 3 * early) AS TINYINT) AS mental_health_days, CAST(least(30, 2 * late) AS TINYINT) AS phys_health_days,
    CAST(mn > 40000 AS TINYINT) AS difficulty_walking, CAST(early >= 3 AS TINYINT) AS sex,
    CAST(floor(c_nationkey / 2.0) + 1 AS TINYINT) AS age_band, CAST(least(6, h + 1) AS TINYINT) AS education,
    CAST(floor((c_acctbal + 1000) / 1375) + 1 AS TINYINT) AS income_band
  FROM c
)
"""

WILSON_LOW = ("CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 THEN 0.0 ELSE "
              "(({k}::DOUBLE / {n}) + 3.841458820694124 / (2 * {n})) / (1 + 3.841458820694124 / {n}) "
              "- 1.959963984540054 / (1 + 3.841458820694124 / {n}) * sqrt(({k}::DOUBLE / {n}) * (1 - {k}::DOUBLE / {n}) / {n} "
              "+ 3.841458820694124 / (4.0 * {n} * {n})) END")
WILSON_HIGH = ("CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1.0 ELSE "
               "(({k}::DOUBLE / {n}) + 3.841458820694124 / (2 * {n})) / (1 + 3.841458820694124 / {n}) "
               "+ 1.959963984540054 / (1 + 3.841458820694124 / {n}) * sqrt(({k}::DOUBLE / {n}) * (1 - {k}::DOUBLE / {n}) / {n} "
               "+ 3.841458820694124 / (4.0 * {n} * {n})) END")


def wilson_low(k: str, n: str) -> str:
    return WILSON_LOW.format(k=k, n=n)


def wilson_high(k: str, n: str) -> str:
    return WILSON_HIGH.format(k=k, n=n)


def chi2_tail(x: str, dof: str) -> str:
    """Upper tail of chi-square, one minus the series of the regularised gamma function; 0 far out, 1 at zero."""
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 500 THEN 0.0 WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum([exp(-({x}) / 2.0 "
            f"+ (({dof}) / 2.0 + j) * ln(({x}) / 2.0) - lgamma(({dof}) / 2.0 + j + 1)) FOR j IN range(600)])) END")


def stacked(columns: list[str], source: str, name: str = "variable", value: str = "value", extra: str = "",
            cast: str = "DOUBLE") -> str:
    """UNION ALL of one SELECT per column."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS {name}, CAST(\"{c}\" AS {cast}) AS {value}{', ' + extra if extra else ''} FROM {source}"
        for c in columns)


__all__ = ["ENCOUNTERS", "SURVEY", "CATEGORICAL", "UTILIZATION", "chi2_tail", "stacked", "wilson_low", "wilson_high"]
