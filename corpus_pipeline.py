"""A training-corpus pipeline: toxic documents go, one of each near-duplicate group stays, contaminated
documents go, sources are mixed to their target weights, and the rest is dealt to shards.

Every stage reads what its predecessor wrote and decides over all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontaminate, feistel, mixing, simhash, toxicity
from cohortlens.llm.common import fresh, table
from cohortlens.session import materialize

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model is fitted on the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    own = {c: fresh(docs, f"_own_{c}") for c in docs.columns if c.lower() in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    marked = decontaminate.find_contamination(docs.withColumnsRenamed(own), table(spark, sf_dir, "benchmark"))
    clean = marked.where("NOT contaminated").drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return clean.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with ``shard`` and ``slot``."""
    return feistel.shard_rows(docs, shards=SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each_group), ("decontamination", drop_contaminated),
    ("mixing", mix_sources), ("sharding", deal_to_shards)]

#: The neighbours' votes, XXH64 fingerprints and hash-drawn blocks have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
