"""Exclusions, event sequences and first-event cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators.ordered import ordered_scan


def post_absorbing_entities(df: DataFrame, entity: str, event: str, absorbing: Column) -> DataFrame:
    """Entities with any event later than one of their absorbing events (distinct, one column).

    "Some later event exists" is "the last event is later than the first absorbing one", so one
    map-side combined aggregate replaces the self join.
    """
    return (
        df.groupBy(entity)
        .agg(F.min(F.when(absorbing, F.col(event))).alias("_first_absorbing"), F.max(event).alias("_last"))
        .where(F.col("_last") > F.col("_first_absorbing"))
        .select(entity)
    )


def without_entities(df: DataFrame, banned: DataFrame, entity: str) -> DataFrame:
    """Rows whose entity is not in ``banned`` (rows with a null entity are kept)."""
    return df.join(banned, entity, "left_anti")


def sequence_events(df: DataFrame, entity: str, order: list[str], **scan: object) -> DataFrame:
    """Add ``encounter_seq`` (1-based) and ``patient_encounter_count`` (whole history)."""
    return ordered_scan(df, [entity], order, position="encounter_seq", size="patient_encounter_count", **scan)


def first_events(df: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """First row per entity plus the entity's row count, by one aggregate instead of a window."""
    rest = [c for c in df.columns if c != entity]
    return (
        df.groupBy(entity)
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_r"),
             F.count(F.lit(1)).alias("patient_encounter_count"))
        .select(entity, "_r.*", "patient_encounter_count")
    )
