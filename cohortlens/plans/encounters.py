"""Encounter tables: raw text to silver, fact, cohort and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions import cleaning as C
from cohortlens.functions.rates import ratio
from cohortlens.operators import cohort, profile

# Fixed values of the source data.
DRUGS = [
    "metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride", "acetohexamide", "glipizide",
    "glyburide", "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose", "miglitol", "troglitazone",
    "tolazamide", "insulin", "glyburide-metformin", "glipizide-metformin", "glimepiride-pioglitazone",
    "metformin-rosiglitazone", "metformin-pioglitazone",
]
EXPIRED = [11, 19, 20]
HOSPICE = [13, 14]
EXPIRED_OR_HOSPICE = EXPIRED + HOSPICE
INT_COLUMNS = [
    "admission_type_id", "discharge_disposition_id", "admission_source_id", "time_in_hospital",
    "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient", "number_emergency",
    "number_inpatient", "number_diagnoses",
]
PRIOR_VISITS = ["number_inpatient", "number_emergency", "number_outpatient"]

# Features by kind, and terms of the odds model.
NUMERIC = [
    "time_in_hospital", "num_lab_procedures", "num_medications", "num_procedures", "number_diagnoses",
    "number_inpatient", "number_emergency", "number_outpatient", "age_midpoint", "n_active_diabetes_meds",
    "procedures_per_day", "meds_per_day", "labs_per_day",
]
BINARY = [
    "a1c_tested", "any_med_adjusted", "a1c_tested_and_changed", "any_number_inpatient", "any_number_emergency",
    "any_number_outpatient", "high_prior_utilizer", "is_hospice",
]
CATEGORICAL = [
    "diag_1_group", "admission_type_id", "admission_source_id", "discharge_disposition_id", "gender",
    "max_glu_serum", "a1c_result",
]
#: Inputs of the anomaly and phenotype models: the numeric features without the age.
UTILIZATION = [c for c in NUMERIC if c != "age_midpoint"]
#: Terms of the adjusted odds model.
ODDS_TERMS = [
    "a1c_tested", "any_med_adjusted", "a1c_tested_and_changed", "number_diagnoses", "n_active_diabetes_meds",
    "time_in_hospital", "num_medications", "num_procedures", "any_number_inpatient", "any_number_emergency",
    "any_number_outpatient", "age_midpoint", "is_hospice",
]
#: Columns no model may see, with the reason.
NEVER_FEATURES = {
    "readmitted": "raw outcome",
    "readmitted_30d": "target",
    "patient_encounter_count": "counts future events",
    "encounter_seq": "constant in a first-event cohort",
    "encounter_id": "identifier",
    "patient_nbr": "identifier",
    "race": "audit attribute only",
    "med_changed": "mislabelled source column",
}


def typed_encounters(raw: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Typed and cleaned rows of the all-text raw table with their flags, none left out; ``extra`` expressions pass through."""
    typed = raw.selectExpr(
        "CAST(encounter_id AS BIGINT) AS encounter_id",
        "CAST(patient_nbr AS BIGINT) AS patient_nbr",
        "nullif(race, '?') AS race",
        "CASE WHEN gender IN ('Male', 'Female') THEN gender END AS gender",
        "age AS age_band",
        *[f"CAST({c} AS INT) AS {c}" for c in INT_COLUMNS],
        *[f"nullif({c}, '?') AS {c}" for c in ("medical_specialty", "payer_code", "diag_1", "diag_2", "diag_3")],
        "nullif(max_glu_serum, 'None') AS max_glu_serum",
        "nullif(A1Cresult, 'None') AS a1c_result",
        *[f"`{c}`" for c in DRUGS],
        "change AS med_change",
        "diabetesMed AS on_diabetes_med",
        "readmitted",
        *(extra or []),
    )
    code = F.col("discharge_disposition_id")
    return typed.withColumns({
        "is_expired": code.isin(EXPIRED),
        "is_hospice": code.isin(HOSPICE),
        "readmitted_30d": C.flag(F.col("readmitted") == "<30"),
        "a1c_tested": C.flag(F.col("a1c_result").isNotNull()),
        "med_changed": C.flag(F.col("med_change") == "Ch"),
    })


def silver(raw: DataFrame) -> DataFrame:
    """Typed, cleaned and filtered encounters from the all-text raw table."""
    return cohort.without_entities(
        typed_encounters(raw).where(~F.col("is_expired") & F.col("gender").isNotNull()),
        post_expired_patients(raw),
        "patient_nbr",
    )


def post_expired_patients(raw: DataFrame) -> DataFrame:
    ids = raw.select(
        F.col("patient_nbr").cast("bigint").alias("patient_nbr"),
        F.col("encounter_id").cast("bigint").alias("encounter_id"),
        F.col("discharge_disposition_id").cast("int").alias("code"),
    )
    return cohort.post_absorbing_entities(ids, "patient_nbr", "encounter_id", F.col("code").isin(EXPIRED))


def fact_columns(clean: DataFrame) -> DataFrame:
    return (
        clean.withColumn("_number", C.number_or_null("diag_1"))
        .withColumns({
            "diag_1_group": C.code_group("diag_1", "_number"),
            "age_midpoint": C.band_midpoint("age_band"),
            "prior_visits_total": F.col("number_outpatient") + F.col("number_emergency") + F.col("number_inpatient"),
        })
        .drop("_number", "diag_2", "diag_3", "med_change", "is_expired")
    )


def fact(clean: DataFrame, **scan: object) -> DataFrame:
    """One row per retained encounter with its place in the patient's history."""
    return cohort.sequence_events(fact_columns(clean), "patient_nbr", ["encounter_id"], **scan)


def first_cohort(clean: DataFrame) -> DataFrame:
    """First retained encounter per patient: the fact rows with ``encounter_seq = 1``."""
    first = cohort.first_events(fact_columns(clean), "patient_nbr", ["encounter_id"])
    return first.withColumn("encounter_seq", F.lit(1).cast("bigint"))


def add_features(df: DataFrame) -> DataFrame:
    """Model-ready features; drug and fill columns absent from ``df`` are skipped."""
    drugs = [c for c in DRUGS if c in df.columns]
    days = F.greatest(F.col("time_in_hospital"), F.lit(1))
    out = df.withColumns({
        # a missing drug entry is not 'No', so it counts as active
        "n_active_diabetes_meds": C.count_where(drugs, "{c} IS NULL OR {c} <> 'No'"),
        "any_med_adjusted": C.any_where(drugs, "{c} IN ('Up', 'Down')"),
        "procedures_per_day": ratio(F.col("num_procedures"), days),
        "meds_per_day": ratio(F.col("num_medications"), days),
        "labs_per_day": ratio(F.col("num_lab_procedures"), days),
        **{f"log_{c}": F.log1p(c) for c in PRIOR_VISITS},
        **{f"any_{c}": C.flag(F.col(c) > 0) for c in PRIOR_VISITS},
        "high_prior_utilizer": C.flag(F.col("number_inpatient") >= 2),
        "is_hospice": F.col("is_hospice").cast("int"),
    })
    out = out.withColumn("a1c_tested_and_changed", F.col("a1c_tested") * F.col("any_med_adjusted"))
    fill = ["race", "medical_specialty", "payer_code", "max_glu_serum", "a1c_result"]
    return out.fillna("Missing", subset=[c for c in fill if c in out.columns])


def dq_report(raw: DataFrame, survey: DataFrame | None = None) -> DataFrame:
    """Metric/value report from one pass over the raw rows.

    Rows are reduced to counts and flags per patient, which decide whether the patient is left out, and
    these are summed up.
    """
    rows = typed_encounters(raw, ["gender AS _raw_gender"])
    kept = F.coalesce(~F.col("is_expired") & F.col("gender").isNotNull(), F.lit(False))
    silver_counts = {
        "silver_encounter_rows": kept,
        "retained_hospice": kept & F.col("is_hospice"),
        "readmit_30d_positives": kept & (F.col("readmitted_30d") == 1),
        "null_race": kept & F.col("race").isNull(),
        "null_payer_code": kept & F.col("payer_code").isNull(),
        "null_medical_specialty": kept & F.col("medical_specialty").isNull(),
        "a1c_tested": kept & (F.col("a1c_tested") == 1),
    }
    patients = rows.groupBy("patient_nbr").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("is_expired").alias("_expired"),
        F.count_if(~F.col("_raw_gender").isin("Male", "Female")).alias("_unknown"),
        F.min(F.when(F.col("is_expired"), F.col("encounter_id"))).alias("_first_absorbing"), F.max("encounter_id").alias("_last"),
        *[F.count_if(c).alias(f"_k_{name}") for name, c in silver_counts.items()])
    late = F.coalesce(F.col("_last") > F.col("_first_absorbing"), F.lit(False))
    stays = ~late | F.col("patient_nbr").isNull()
    out = profile.tall_metrics(patients, {
        "bronze_encounter_rows": F.sum("_rows"),
        "dropped_expired": F.sum("_expired"),
        "dropped_unknown_gender": F.sum("_unknown"),
        "distinct_patients": F.count_if(stays & (F.col("_k_silver_encounter_rows") > 0) & F.col("patient_nbr").isNotNull()),
        "excluded_post_death_sequence": F.count_if(late),
        **{name: F.sum(F.when(stays, F.col(f"_k_{name}")).otherwise(0)) for name in silver_counts},
    })
    if survey is not None:
        out = out.unionByName(profile.tall_metrics(survey, {"brfss_rows": F.count(F.lit(1))}))
    return out


def disposition_audit(raw: DataFrame) -> DataFrame:
    """Outcome rate per disposition code with the treatment the code receives."""
    code = F.col("disposition_id")
    return (
        raw.groupBy(F.col("discharge_disposition_id").cast("int").alias("disposition_id"))
        .agg(
            F.count(F.lit(1)).alias("n_encounters"),
            F.round(100.0 * F.avg(C.flag(F.col("readmitted") == "<30")), 3).alias("pct_readmit_30d"),
        )
        .withColumn("treatment", F.when(code.isin(EXPIRED), "excluded_expired")
                    .when(code.isin(HOSPICE), "retained_hospice").otherwise("retained"))
        .orderBy(F.asc_nulls_last("pct_readmit_30d"), F.desc("n_encounters"), "disposition_id")
    )


def check_features(features: list[str], banned: dict[str, str] | None = None) -> None:
    """Raise when a banned column is in the feature list."""
    banned = NEVER_FEATURES if banned is None else banned
    leaked = {c: banned[c] for c in features if c in banned}
    if leaked:
        raise ValueError(f"leakage columns in feature set: {leaked}")
