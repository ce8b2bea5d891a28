"""Encounter- and survey-shaped raw tables derived from order data.

The provided tables hold customers, orders and line items. Here an order plays an encounter, its
customer the patient, and a customer's order history a survey respondent, in the raw shapes the
pipelines of this package read. Every row of the source tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators.ordered import ordered_scan
from cohortlens.plans import encounters, survey
from cohortlens.session import materialize
from cohortlens.sources.tables import read_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def drug_slots() -> list[tuple[str, int, str]]:
    """Each drug column reads the lines of one (line number, return flag) pair: 7 x 3 = 21."""
    pairs = [(n, r) for n in range(1, 8) for r in ("A", "N", "R")]
    return [(drug, n, r) for drug, (n, r) in zip(encounters.DRUGS, pairs)]


def order_lines(lineitem: DataFrame) -> DataFrame:
    """One row per order with the counts the encounter columns are made of."""
    discount = F.col("l_discount")
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("int").alias("n_lines"),
        F.sum("l_quantity").cast("int").alias("qty"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("n_returned"),
        F.count_if(F.col("l_quantity") > 20).cast("int").alias("n_bulk"),
        F.count_if(discount >= 0.1).cast("int").alias("n_deep"),
        F.count_if(F.col("l_tax") >= 0.08).cast("int").alias("n_taxed"),
        F.count_if(F.col("l_linestatus") == "O").cast("int").alias("n_open"),
        F.max("l_discount").alias("max_discount"),
        *[F.expr(f"max(CASE WHEN l_linenumber = {n} AND l_returnflag = '{r}' THEN l_discount END) AS d_{n}{r}")
          for _, n, r in drug_slots()],
    )


def raw_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text encounter rows from orders, their lines and their customer."""
    orders = table(spark, sf_dir, "orders")
    seq = ordered_scan(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                       position="seq", lead={"next_date": "o_orderdate"})
    lines = order_lines(table(spark, sf_dir, "lineitem"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    o = (
        seq.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .fillna(0, subset=["n_lines", "qty", "n_returned", "n_bulk", "n_deep", "n_taxed", "n_open"])
    )
    price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    decade = F.floor(F.col("c_nationkey") / 2.5).cast("int") * 10
    k = F.floor(price / 500).cast("int").cast("string")
    lines_n = F.col("n_lines")

    pending = F.when(price >= 492000, 11)
    for low, code in [(489000, 19), (487000, 20), (470000, 13), (455000, 14), (430000, 7), (420000, 9), (415000, 99)]:
        pending = pending.when(price >= low, code)
    code = (
        F.when(status == "P", pending.otherwise(1))
        .when(status == "F", F.when(priority == "1-URGENT", 3).when(priority == "2-HIGH", 6).otherwise(1))
        .otherwise(F.when(priority == "5-LOW", 18).when(priority == "4-NOT SPECIFIED", 22)
                   .when(priority == "3-MEDIUM", 2).otherwise(1))
    )
    return o.select(*[c.cast("string").alias(name) for name, c in {
        "encounter_id": F.col("o_orderkey"),
        "patient_nbr": F.col("o_custkey"),
        "race": F.when(F.col("c_mktsegment") == "HOUSEHOLD", "?").otherwise(F.col("c_mktsegment")),
        "gender": F.when(F.col("c_acctbal") < -900, "Unknown/Invalid").when(F.col("c_acctbal") < 4500, "Female").otherwise("Male"),
        "age": F.concat(F.lit("["), decade.cast("string"), F.lit("-"), (decade + 10).cast("string"), F.lit(")")),
        "admission_type_id": F.substring("o_orderpriority", 1, 1),
        "discharge_disposition_id": code,
        "admission_source_id": F.month("o_orderdate"),
        "time_in_hospital": lines_n,
        "num_lab_procedures": F.col("qty"),
        "num_procedures": F.col("n_returned"),
        "num_medications": F.col("n_bulk"),
        "number_outpatient": F.col("n_deep"),
        "number_emergency": F.col("n_taxed"),
        "number_inpatient": F.col("seq") - 1,
        "number_diagnoses": F.col("n_open") + 1,
        "medical_specialty": F.when(priority == "4-NOT SPECIFIED", "?").otherwise(priority),
        "payer_code": F.when(F.col("c_nationkey") < 5, "?").otherwise(F.col("c_nationkey").cast("string")),
        "diag_1": F.when(lines_n == 0, "?").when((priority == "5-LOW") & (status == "O"), F.concat(F.lit("V"), k))
        .when((priority == "1-URGENT") & (status == "F"), F.concat(F.lit("E"), k))
        .otherwise(F.concat(k, F.lit("."), F.least(lines_n, F.lit(9)).cast("string"))),
        "diag_2": F.when(lines_n < 2, "?").otherwise(k),
        "diag_3": F.when(lines_n < 3, "?").otherwise(k),
        "max_glu_serum": F.when(F.col("qty") < 50, "None").when(F.col("qty") < 100, "Norm")
        .when(F.col("qty") < 150, ">200").otherwise(">300"),
        "A1Cresult": F.when(F.col("max_discount") >= 0.09, ">8").when(F.col("max_discount") >= 0.07, ">7")
        .when(F.col("max_discount") >= 0.05, "Norm").otherwise("None"),
        **{drug: F.expr(f"CASE WHEN d_{n}{r} >= 0.09 THEN 'Up' WHEN d_{n}{r} <= 0.01 THEN 'Down' "
                        f"WHEN d_{n}{r} IS NULL THEN 'No' ELSE 'Steady' END") for drug, n, r in drug_slots()},
        "change": F.when(F.col("n_returned") > 0, "Ch").otherwise("No"),
        "diabetesMed": F.when(lines_n > 0, "Yes").otherwise("No"),
        "readmitted": F.when(F.col("next_date").isNull(), "NO")
        .when(F.col("next_date") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "<30").otherwise(">30"),
    }.items()])


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numeric respondent row per customer from the order history, keyed ``row_id``."""
    orders = table(spark, sf_dir, "orders")
    status, priority, date = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate")
    counts = {
        "n": F.lit(True), "f": status == "F", "p": status == "P", "u": priority == "1-URGENT",
        "h": priority == "2-HIGH", "m": priority == "3-MEDIUM", "l": priority == "5-LOW",
        "early": F.year(date) < 1997, "late": F.year(date) >= 2000, "w": F.month(date).isin(12, 1, 2),
    }
    history = orders.groupBy("o_custkey").agg(
        *[F.count_if(c).alias(name) for name, c in counts.items()],
        F.max("o_totalprice").alias("mx"), F.min("o_totalprice").alias("mn"))
    c = table(spark, sf_dir, "customer").join(history, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(
        0, subset=[*counts, "mx", "mn"])
    col, bal = F.col, F.col("c_acctbal")
    segment = F.when(col("c_mktsegment") == "BUILDING", 1)
    for i, s in enumerate(["MACHINERY", "AUTOMOBILE", "FURNITURE"], start=2):
        segment = segment.when(col("c_mktsegment") == s, i)
    return c.select(col("c_custkey").alias("row_id"), *[e.cast("double").alias(name) for name, e in {
        "Diabetes_binary": col("f") >= 5,
        "Stroke": col("u") >= 4,
        "HeartDiseaseorAttack": col("mx") > 492000,
        "BMI": 12 + F.floor(col("mn") / 10000),
        "HighBP": col("n") >= 10,
        "HighChol": col("p") >= 4,
        "CholCheck": col("m") + col("l") >= 2,
        "Smoker": bal < 1000,
        "PhysActivity": col("late") >= 3,
        "Fruits": col("l") >= 2,
        "Veggies": col("m") >= 2,
        "HvyAlcoholConsump": col("w") >= 5,
        "AnyHealthcare": col("mn") < 60000,
        "NoDocbcCost": bal < 0,
        "GenHlth": segment.otherwise(5),
        "MentHlth": F.least(F.lit(30), 3 * col("early")),
        "PhysHlth": F.least(F.lit(30), 2 * col("late")),
        "DiffWalk": col("mn") > 40000,
        "Sex": col("early") >= 3,
        "Age": F.floor(col("c_nationkey") / 2) + 1,
        "Education": F.least(F.lit(6), col("h") + 1),
        "Income": F.floor((bal + 1000) / 1375) + 1,
    }.items()])


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters.silver(raw_encounters(spark, sf_dir))


def cohort_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters.add_features(encounters.first_cohort(silver(spark, sf_dir)))


def cohort_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Cohort columns written once, for operators that read their input several times."""
    return materialize(cohort_features(spark, sf_dir).select(*columns))


def survey_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.silver(raw_survey(spark, sf_dir))


SCORES = ["rule_baseline", "score_a", "score_b"]


def scored_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort with one single-column rule and two fixed-formula probabilities."""
    def logistic(x):
        return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-x)), 6)
    c = F.col
    return cohort_features(spark, sf_dir).withColumns({
        "rule_baseline": c("number_inpatient").cast("double"),
        "score_a": logistic(0.08 * c("number_inpatient") + 0.05 * c("time_in_hospital") - 2.5),
        "score_b": logistic(0.01 * c("num_lab_procedures") - 0.1 * c("num_procedures") - 2.2),
    })


def scored_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Scored cohort columns written once."""
    return materialize(scored_cohort(spark, sf_dir).select(*columns))
