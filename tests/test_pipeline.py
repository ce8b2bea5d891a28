"""Raw files to silver, fact and cohort; sources and sinks; sequences; checks."""

import csv
import itertools

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort, quality, sequences
from cohortlens.plans import encounters as E, survey as S
from cohortlens.sources import tables as T

RAW = ["encounter_id", "patient_nbr", "race", "gender", "age", *E.INT_COLUMNS, "medical_specialty", "payer_code", "diag_1",
       "diag_2", "diag_3", "max_glu_serum", "A1Cresult", *E.DRUGS, "change", "diabetesMed", "readmitted"]


def raw_row(encounter, patient, code=1, **kw):
    base = {c: "No" for c in E.DRUGS} | {c: "1" for c in E.INT_COLUMNS}
    base |= {"race": "?", "gender": "Female", "age": "[70-80)", "medical_specialty": 'Surgery, "General"', "payer_code": "?",
             "diag_1": "250.8", "diag_2": "?", "diag_3": "?", "max_glu_serum": "None", "A1Cresult": ">7", "change": "Ch",
             "diabetesMed": "Yes", "readmitted": "NO"}
    base |= {"encounter_id": str(encounter), "patient_nbr": str(patient), "discharge_disposition_id": str(code)} | kw
    return [base[c] for c in RAW]


@pytest.fixture
def raw(spark, tmp_path):
    path = tmp_path / "raw.csv"
    rows = [
        raw_row(10, 1), raw_row(11, 1, readmitted="<30"), raw_row(12, 2, 11), raw_row(13, 2), raw_row(14, 3, 13),
        raw_row(15, 4, gender="Unknown/Invalid"), raw_row(16, 5, 20), raw_row(9, 5), raw_row(20, 6, 7), raw_row(21, 6, 99),
    ]
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(RAW)
        w.writerows(rows)
    return T.with_lineage(T.read_text_csv(spark, str(path)), "file:raw.csv")


def test_raw_is_text_with_quotes_kept(raw):
    assert {t for n, t in raw.dtypes if n not in ("ingested_at",)} == {"string"}
    assert raw.first()["medical_specialty"] == 'Surgery, "General"' and raw.first()["_source"] == "file:raw.csv"


def test_silver_filters(raw):
    clean = E.silver(raw)
    assert sorted(r["encounter_id"] for r in clean.collect()) == [9, 10, 11, 14, 20, 21]
    r = clean.where("encounter_id = 11").first()
    assert (r["race"], r["a1c_tested"], r["max_glu_serum"], r["readmitted_30d"], r["med_changed"]) == (None, 1, None, 1, 1)
    assert [r[0] for r in E.post_expired_patients(raw).collect()] == [2]


def test_cohort_equals_first_fact_row_in_any_input_order(raw):
    clean = E.silver(raw)
    fact = E.fact(clean)
    want = sorted(map(str, fact.where("encounter_seq = 1").select(sorted(fact.columns)).collect()))
    for n in (1, 7):
        got = E.first_cohort(clean.orderBy(F.desc("encounter_id")).repartition(n))
        assert sorted(map(str, got.select(sorted(fact.columns)).collect())) == want
    counts = {r["patient_nbr"]: r["patient_encounter_count"] for r in fact.collect()}
    assert counts == {1: 2, 3: 1, 5: 1, 6: 2}


def test_dq_report(raw):
    got = {r["metric"]: r["value"] for r in E.dq_report(raw).collect()}
    assert got["bronze_encounter_rows"] == 10 and got["silver_encounter_rows"] == 6
    assert got["dropped_expired"] == 2 and got["dropped_unknown_gender"] == 1
    assert got["excluded_post_death_sequence"] == 1 and got["retained_hospice"] == 1 and got["distinct_patients"] == 4


def test_bad_number_raises(spark, raw):
    broken = raw.withColumn("time_in_hospital", F.lit("x"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        E.silver(broken).collect()


def test_transitions(raw):
    ids = raw.select(F.col("encounter_id").cast("long").alias("encounter_id"), F.col("patient_nbr").cast("long").alias("p"),
                     F.col("discharge_disposition_id").cast("int").alias("code"))
    s = sequences.with_state(ids, "code", sequences.DISPOSITION_STATES)
    pairs = sequences.transitions(s, "p", "encounter_id", ["encounter_id"])
    got = {(r["p"], r["prev_state"], r["state"], r["illegal"], r["notable"], r["prev_encounter_id"]) for r in pairs.collect()}
    assert got == {(1, "HOME", "HOME", False, False, 10), (2, "EXPIRED", "HOME", True, False, 12),
                   (5, "HOME", "EXPIRED", False, False, 9), (6, "LEFT_AMA", "UNKNOWN", False, True, 20)}
    flagged = {r["p"] for r in pairs.where("illegal").collect()}
    assert flagged == {r[0] for r in cohort.post_absorbing_entities(ids, "p", "encounter_id", F.col("code").isin(E.EXPIRED)).collect()}


def test_post_absorbing_against_brute_force(spark):
    events = [(p, i, (p * 7 + i * 3) % 5 == 0) for p in range(20) for i in range(p % 4 + 1)]
    df = spark.createDataFrame(events, "p int, i int, a boolean")
    want = {p for (p, i, a), (q, j, _) in itertools.product(events, events) if p == q and a and j > i}
    assert {r[0] for r in cohort.post_absorbing_entities(df, "p", "i", F.col("a")).collect()} == want


def test_typed_csv_and_survey(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(",".join(S.RENAMES) + "\n" + ",".join("1.0" if c != "BMI" else "27.5" for c in S.RENAMES) + "\n")
    raw = T.read_typed_csv(spark, str(path))
    assert {t for _, t in raw.dtypes} == {"double"}
    r = S.silver(raw).first()
    assert r["bmi"] == 27.5 and r["has_stroke"] == 1


def test_coerced_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("a,b\n1,x\n?,y\n")
    assert [tuple(r) for r in T.read_text_csv(spark, str(path), ["a"]).collect()] == [(1.0, "x"), (None, "y")]


def test_layers_sinks_and_fingerprint(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    listing = T.build_layers(spark, {"bronze": {"raw": lambda: df}, "gold": {"fact": lambda: df.where("v = 1")}}, str(tmp_path))
    assert {tuple(r) for r in listing.collect()} == {("bronze", "raw"), ("gold", "fact")}
    back = T.read_parquet(spark, f"{tmp_path}/gold/fact", ["id", "v"])
    assert back.count() == 3
    with pytest.raises(ValueError, match=r"\['w'\]"):
        T.read_parquet(spark, f"{tmp_path}/gold/fact", ["id", "w"])
    a = T.table_fingerprint(df).first()
    assert a == T.table_fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()
    assert a != T.table_fingerprint(df.withColumn("v", F.col("v") + 1)).first()
    T.write_report(df, f"{tmp_path}/r")
    assert T.read_text_csv(spark, f"{tmp_path}/r").count() == 10
    T.write_metadata(T.metadata_row(df.agg(F.count(F.lit(1)).alias("n")), seed=42, versions={"a": "1"}), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first()["versions"]["a"] == "1"
    assert T.file_fingerprints(spark, f"{tmp_path}/m").where("length > 0").count() >= 1


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 1.5), (2, 2, None)], "k int, y int, p double")
    with pytest.raises(ValueError, match="one row per"):
        quality.require_unique_key(df, "k")
    with pytest.raises(ValueError, match="'p': 2"):
        quality.require_domain(df, {"p": quality.probability("p")})
    ok = df.where("k = 1")
    assert quality.require_domain(ok, {"y": quality.binary("y"), "c": quality.complete(["k", "p"])}) is ok
    right = spark.createDataFrame([(1, 1, "z"), (3, 0, "w")], "k int, y int, z string")
    joined = quality.one_to_one(ok, right, "k", "y").first()
    assert (joined["z"], joined["y_baseline"]) == ("z", 1)
    with pytest.raises(ValueError, match="do not match"):
        quality.one_to_one(ok, right.withColumn("y", F.lit(0)), "k", "y")
    with pytest.raises(ValueError, match="partner"):
        quality.one_to_one(spark.createDataFrame([(9,)], "k int"), right, "k")
