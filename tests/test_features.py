"""Hand-built one-row cases of the derived features and cleaning rules."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import cleaning as C
from cohortlens.plans import encounters as E

BASE = {
    **{d: "No" for d in E.DRUGS}, "time_in_hospital": 3, "num_procedures": 2, "num_medications": 6,
    "num_lab_procedures": 9, "number_inpatient": 0, "number_emergency": 0, "number_outpatient": 0, "a1c_tested": 0,
    "med_changed": 0, "is_hospice": False, "race": None, "medical_specialty": None, "payer_code": None,
    "max_glu_serum": None, "a1c_result": None,
}
SCHEMA = ", ".join(f"`{k}` " + ("string" if v is None or isinstance(v, str) else "boolean" if v is False else "int")
                   for k, v in BASE.items())


@pytest.fixture
def row(spark):
    def make(**changes):
        values = {**BASE, **{k.replace("__", "-"): v for k, v in changes.items()}}
        return E.add_features(spark.createDataFrame([tuple(values.values())], SCHEMA)).first()
    return make


def test_medication_counts(row):
    r = row(insulin="Steady", metformin="Up")
    assert (r["n_active_diabetes_meds"], r["any_med_adjusted"]) == (2, 1)
    assert row(insulin="Steady")["any_med_adjusted"] == 0
    assert row(glyburide__metformin="Down")["any_med_adjusted"] == 1
    r = row(insulin=None)  # a missing entry is not 'No'
    assert (r["n_active_diabetes_meds"], r["any_med_adjusted"]) == (1, 0)


def test_rates_guard_zero_stay(row):
    assert row(time_in_hospital=0)["procedures_per_day"] == 2.0
    r = row(time_in_hospital=3)
    assert r["meds_per_day"] == 2.0 and r["labs_per_day"] == 3.0


def test_prior_visits(row):
    r = row()
    assert (r["log_number_inpatient"], r["any_number_inpatient"], r["high_prior_utilizer"]) == (0.0, 0, 0)
    assert row(number_inpatient=1)["high_prior_utilizer"] == 0
    assert row(number_inpatient=2)["high_prior_utilizer"] == 1
    assert row(number_emergency=4)["any_number_emergency"] == 1


@pytest.mark.parametrize("tested,drug,want", [(1, "Up", 1), (0, "Up", 0), (1, "Steady", 0)])
def test_interaction(row, tested, drug, want):
    assert row(a1c_tested=tested, insulin=drug)["a1c_tested_and_changed"] == want


def test_missing_level_and_flag(row):
    r = row()
    assert r["race"] == "Missing" and r["a1c_result"] == "Missing" and r["is_hospice"] == 0


def test_absent_columns_are_skipped(spark):
    keep = [k for k in BASE if k not in ("race", "insulin")]
    df = spark.createDataFrame([tuple(BASE[k] for k in keep)], ", ".join(
        p for p in SCHEMA.split(", ") if p.split("`")[1] in keep))
    assert "race" not in E.add_features(df).columns


def test_code_groups(spark):
    cases = {None: "unknown", "V45": "supplementary", "E812": "supplementary", "250.83": "diabetes", "250": "diabetes",
             "249.9": "endocrine_other", "251": "endocrine_other", "459.8": "other", "390": "circulatory",
             "460": "respiratory", "139.5": "other", "1": "infectious", "140": "neoplasms", "999": "injury",
             "x": "other", "389": "nervous_sensory", "300.4": "mental"}
    df = spark.createDataFrame([(k,) for k in cases], "code string").withColumn("n", C.number_or_null("code"))
    got = {r["code"]: r["g"] for r in df.select("code", C.code_group("code", "n").alias("g")).collect()}
    assert got == cases


def test_small_int_rounds_half_even(spark):
    df = spark.createDataFrame([(1.5,), (2.5,), (1.4,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(C.small_int("x")).collect()] == [2, 2, 1, 0]


def test_band_midpoint(spark):
    df = spark.createDataFrame([("[70-80)",), ("?",)], "b string")
    assert [r[0] for r in df.select(C.band_midpoint("b")).collect()] == [75, None]


def test_source_feature_prefers_longest(spark):
    names = {"cat__gender_Male": "gender", "num__gender_index": "gender", "cat__a1c_result_>7": "a1c_result",
             "num__age_midpoint": "age_midpoint", "cat__a1c_x": "a1c"}
    df = spark.createDataFrame([(n,) for n in names], "e string")
    out = df.select("e", C.source_feature(F.col("e"), ["gender", "a1c", "a1c_result"]).alias("s")).collect()
    assert {r["e"]: r["s"] for r in out} == names


def test_intervals_right_closed(spark):
    df = spark.createDataFrame([(5.0,), (5.1,), (10.0,), (11.0,), (None,)], "v double")
    got = [r[0] for r in df.select(C.interval_label(F.col("v"), [(5, "ok"), (10, "elevated")], "severe")).collect()]
    assert got == ["ok", "elevated", "elevated", "severe", None]


def test_feature_lists_hold_no_banned_column():
    E.check_features(E.NUMERIC + E.BINARY + E.CATEGORICAL + E.UTILIZATION)
    with pytest.raises(ValueError, match="patient_encounter_count"):
        E.check_features(["age_midpoint", "patient_encounter_count"])
