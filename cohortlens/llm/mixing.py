"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks.

Documents of a source are dealt into blocks by a hash. A source's target becomes a number of block
draws: every block ``epochs`` times, then blocks in the order of a seeded permutation up to the
target; of the block where the target falls, single documents fill the rest. The draws of all
sources are then split over the output shards by a tree: at each node the left half of the shards gets
its share of all draws, and how many of them come from which source is one multivariate
hypergeometric draw. A leaf's counts cut each source's permuted draws into disjoint runs, and rows
are ordered inside their shard by a hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlens.llm.common import fresh, table_of
from cohortlens.operators.ordered import ordered_scan
from cohortlens.session import materialize

#: Documents a block holds on average, whatever the size of its source.
BLOCK_ROWS = 256
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], factor: float = 1.5, most: float = 2.0) -> list[float]:
    """Share ``factor`` times the summed sizes by weight; what exceeds ``most`` times a size is shared anew."""
    out = [0.0] * len(sizes)
    left, open_ = factor * sum(sizes), list(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws per (shard, source), columns summing to ``counts`` and rows equal to within one.

    Every node draws from a generator seeded by the seed and its range of shards.
    """
    out = np.zeros((shards, len(counts)), np.int64)

    def go(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        mid = (first + last) // 2
        total = int(have.sum())
        left = total * (mid - first) // (last - first)
        drawn = _hypergeometric(np.random.default_rng([seed, first, last]), have, left)
        go(first, mid, drawn)
        go(mid, last, have - drawn)

    if len(counts):
        go(0, shards, np.array(counts, np.int64))
    return out


def _hypergeometric(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric, source by source."""
    drawn, rest = np.zeros_like(have), int(have.sum())
    for i, k in enumerate(have.tolist()):
        rest -= k
        if n and k:
            # numpy's generator takes populations below 1e9 blocks (2.5e11 documents); beyond, the expected count is taken
            drawn[i] = rng.hypergeometric(k, rest, n) if k + rest < 10**9 else min(k, max(n - rest, round(n * k / (k + rest))))
        n -= int(drawn[i])
    return drawn


class Mix:
    """Facts, targets and draws of a mix. ``rows`` is a written table (source, doc_id, size, h, block, ...)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: dict[str | None, float] | None = None, factor: float = 1.5, most: float = 2.0, seed: int = 42,
                 shards: int = 8) -> None:
        """``weights`` by source name; by default the fixed ones in order of the names, null last.

        Sources are a catalogue: their names and totals (a row each) come to the driver.
        """
        spark = docs.sparkSession
        narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
                             F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
        rows = materialize(narrow)
        facts = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
        facts.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.names = [r["source"] for r in facts]
        self.sizes = [r["words"] for r in facts]
        share = [float(weights.get(s, 0.0)) for s in self.names] if weights else [float(WEIGHTS[i % 3]) for i in range(len(facts))]
        self.targets = targets(self.sizes, share, factor, most)
        n_blocks = [max(1, r["n"] // BLOCK_ROWS) for r in facts]
        epochs = [int(t // s) if s else 0 for t, s in zip(self.targets, self.sizes)]
        rest = [t - e * s for t, e, s in zip(self.targets, epochs, self.sizes)]
        # written, so that Spark knows its size and broadcasts it only while it is small
        self.catalogue = catalogue = materialize(table_of(spark, {
            "k": ("int", list(range(len(facts)))), "name": ("string", self.names), "source_size": ("bigint", self.sizes),
            "target": ("double", self.targets), "n_blocks": ("bigint", n_blocks), "epochs": ("int", epochs), "rest": ("double", rest)}))
        self.rows = rows.join(catalogue, rows.source.eqNullSafe(catalogue.name)).drop("name").withColumn("block", F.expr("pmod(h, n_blocks)"))
        # blocks in permuted order with the words before them; a source with very many blocks is scanned in ranges
        blocks = self.rows.groupBy("k", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("epochs").alias("epochs"))
        blocks = blocks.withColumn("turn", F.xxhash64(F.lit(seed), "k", "block"))
        blocks = ordered_scan(blocks, ["k"], ["turn", "block"], position="nth", running={"upto": "words"})
        blocks = blocks.select("k", "block", "epochs", "words", (F.col("nth") - 1).alias("rank"), (F.col("upto") - F.col("words")).alias("before"), "rest")
        blocks = blocks.withColumn("state", F.when(F.col("before") + F.col("words") <= F.col("rest"), "whole")
                                   .when(F.col("before") < F.col("rest"), "part").otherwise("none"))
        self.blocks = materialize(blocks)
        # draws of a source: epoch after epoch, then the blocks begun for the rest
        begun = {r["k"]: r["n"] for r in self.blocks.where("state <> 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
        draws = [e * b + begun.get(i, 0) for i, (e, b) in enumerate(zip(epochs, n_blocks))]
        self.cuts = np.cumsum(split_tree(draws, shards, seed), axis=0).T.tolist()
        # a row a source, like the catalogue
        self.ends = materialize(table_of(spark, {"k": ("int", list(range(len(self.cuts)))), "cuts": ("array<bigint>", self.cuts)}))
        self.n_blocks, self.epochs, self.shards, self.seed = n_blocks, epochs, shards, seed

    def taken(self, rows: DataFrame | None = None) -> DataFrame:
        """``rows`` with ``copies`` (times the mix takes the document) and the block's ``rank``.

        By default the facts of all documents; other rows need the columns k, block, size, h, doc_id and epochs.
        """
        rows = self.rows if rows is None else rows
        state = self.blocks.select("k", "block", "rank", "state", (F.col("rest") - F.col("before")).alias("gap"))
        at = rows.drop("gap", "rank", "state").join(state, ["k", "block"])
        sure = at.where("state <> 'part'").withColumn("copies", F.expr("epochs + IF(state = 'whole', 1, 0)"))
        # one block a source is filled document by document: large ones first, whatever still fits
        number = fresh(at, "_number")
        part = materialize(at.where("state = 'part'").withColumn(number, F.monotonically_increasing_id()))
        kinds = [part.schema["k"], part.schema[number], T.StructField("copies", T.IntegerType())]

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable")
            gap, chosen = float(pdf["gap"].iloc[0]), []
            for n in pdf["size"].tolist():
                fits = n <= gap
                chosen.append(int(fits))
                gap -= n * fits
            return pdf[["k", number]].assign(copies=(pdf["epochs"].to_numpy() + np.array(chosen)).astype("int32"))

        chosen = part.select("k", number, "size", "h", "doc_id", "gap", "epochs").groupBy("k").applyInPandas(fill, T.StructType(kinds))
        filled = part.join(chosen, ["k", number]).drop(number)
        return sure.select(filled.columns).union(filled)

    def placed(self, docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
        """(row: struct of all columns, and what ``taken`` needs) of the mix's own documents."""
        facts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"),
                            F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
                            F.xxhash64(F.lit(self.seed), F.col(id_col), F.col(text_col)).alias("h"))
        joined = facts.join(self.catalogue, facts.source.eqNullSafe(self.catalogue.name)).drop("name")
        return joined.withColumn("block", F.expr("pmod(h, n_blocks)"))

    def with_shards(self, taken: DataFrame) -> DataFrame:
        """Add ``shards``, one per copy: the run of its source's permuted draws that each block draw falls in."""
        epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
        shards = F.transform(epochs, lambda e: F.size(F.filter("cuts", lambda c: c <= e.cast("bigint") * F.col("n_blocks") + F.col("rank"))))
        return taken.join(self.ends, "k").withColumn("shards", shards)


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, shards) of every document.

    ``shards`` lists the output shard of every copy, comma-joined. Null and blank texts have size 0 and
    null sources are a source of their own. Rows that are alike share their hash, so which of them is
    taken is the same up to exchange; an empty table stays empty. Texts are counted whole, one at a time.
    """
    mix = Mix(docs, **options)
    return mix.with_shards(mix.taken()).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies",
        F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               shard_col: str | None = None, **options: object) -> DataFrame:
    """The mix itself: every document as often as it is taken, each row with its own columns unchanged.

    Rows are dealt and ordered by the output shards of their draws, a shard over several partitions;
    with ``shard_col`` the shard is appended.
    """
    mix = Mix(docs, id_col, text_col, source_col, **options)
    drawn = mix.taken(mix.placed(docs, id_col, text_col, source_col)).where("copies > 0")
    out = mix.with_shards(drawn).select("row", "h", F.posexplode("shards").alias("epoch", "shard"))
    dealt = out.repartition("shard", F.pmod("h", F.lit(64))).sortWithinPartitions("shard", F.xxhash64(F.lit(mix.seed), "epoch", "h"))
    return dealt.select("row.*", *([F.col("shard").alias(shard_col)] if shard_col else []))
