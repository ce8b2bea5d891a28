"""State-transition validation of ordered event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.cleaning import map_code
from cohortlens.operators.ordered import ordered_scan

# Disposition codes by the state they leave the entity in.
DISPOSITION_STATES = {
    "EXPIRED": [11, 19, 20],
    "HOSPICE": [13, 14],
    "LEFT_AMA": [7],
    "STILL_ADMITTED": [9],
    "TRANSFERRED": [2, 3, 4, 5, 10, 15, 16, 17, 22, 23, 24, 27, 28, 29, 30],
    "HOME": [1, 6, 8, 12, 18, 21, 25, 26],
}
ILLEGAL_FROM = ["EXPIRED"]
NOTABLE_FROM = ["HOSPICE", "LEFT_AMA"]


def with_state(df: DataFrame, code: str, states: dict[str, list], name: str = "state") -> DataFrame:
    """Add the state of a code; unlisted and null codes are ``UNKNOWN``."""
    table = {c: state for state, codes in states.items() for c in codes}
    return df.withColumn(name, map_code(F.col(code), table, "UNKNOWN"))


def transitions(
    df: DataFrame, entity: str, event: str, order: list[str], state: str = "state",
    illegal_from: list[str] = ILLEGAL_FROM, notable_from: list[str] = NOTABLE_FROM, **scan: object,
) -> DataFrame:
    """Consecutive event pairs per entity with the previous state and event and both flags."""
    pairs = ordered_scan(df, [entity], order, lag={"prev_state": state, f"prev_{event}": event}, **scan)
    return pairs.where(F.col("prev_state").isNotNull()).withColumns({
        "illegal": F.col("prev_state").isin(illegal_from),
        "notable": F.col("prev_state").isin(notable_from),
    })


def transition_matrix(pairs: DataFrame, states: list[str], state: str = "state") -> DataFrame:
    """Counts of from-state by to-state, zero-filled."""
    return pairs.groupBy("prev_state").pivot(state, states).count().fillna(0)


def sequence_summary(pairs: DataFrame) -> DataFrame:
    """Transitions checked, illegal and notable ones, one row."""
    return pairs.agg(
        F.count(F.lit(1)).alias("transitions"),
        F.count_if("illegal").alias("illegal"),
        F.count_if("notable").alias("notable"),
    )
