"""Importance resampling towards a target distribution, with a distributed quickselect for the draw.

Texts are hashed to buckets of word runs. A bucket's gain compares its share in a target table with
its share in the documents; a document's weight is the sum of gains over its features, looked up in
one array. Adding Gumbel noise from a hash of the id turns "take the k largest" into a draw by weight.

The k-th largest is found without sorting all rows: every round takes a few random rows of the
window as pivots, counts exactly how many rows lie below, at and above each, and goes on between the
two pivots that enclose rank k. A window with no more rows than pivots ends the search, and each
round leaves about one part in ``PIVOTS`` of the window, so n rows take some log n / log PIVOTS
rounds over a narrow written table. Only the drawn rows are sorted and ranked.

Bounds: the driver holds one number a bucket and a few pivots; a task one number a bucket and at most
``MEMORY_WORDS`` remembered words. Long texts are taken whole, one at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import fresh, map_arrow, raw_texts
from cohortlens.llm.decontaminate import words_of
from cohortlens.llm.feistel import number_rows
from cohortlens.session import materialize

BUCKETS = 10_000
#: Rows compared in one round of the selection.
PIVOTS = 15
#: Distinct words a worker remembers the bucket of before it starts anew.
MEMORY_WORDS = 500_000


class _Buckets(dict):
    """Word -> bucket, each computed once."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        bucket = self[word] = zlib.crc32(word) % self.n
        return bucket


def text_features(words: list[bytes], longest: int, buckets: _Buckets) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` consecutive words, with repeats."""
    single = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    if longest == 1:
        return single
    parts, checks = [single], [zlib.crc32(w) for w in words]
    for length in range(2, min(longest, len(words)) + 1):
        # a checksum goes on where the run before it ended
        checks = [zlib.crc32(b" " + w, c) for c, w in zip(checks, words[length - 1:])]
        parts.append(np.array(checks, np.int64) % buckets.n)
    return np.concatenate(parts)


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a whole table per bucket. Each task adds up its own; at most ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                total += np.bincount(text_features(words_of(text or b""), longest, memory), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = df.select(text_col).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) per bucket, each count raised by one."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def hash_noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256("seed:id"); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def score_texts(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1,
                seed: int = 2024, keep: list[str] | None = None) -> DataFrame:
    """The id and ``keep`` with n_words, n_features, weight and score of every row; a null text has no words."""
    names = ("n_words", "n_features", "weight", "score")
    rows = docs.select(id_col, *[c for c in keep or [] if c not in (id_col, *names)], F.col(text_col).alias(fresh(docs, "_text")))

    def measure(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        memory = _Buckets(len(gains))
        out = np.zeros((3, batch.num_rows), np.int64)
        for i, t in enumerate(raw_texts(batch.column(batch.num_columns - 1))):
            words = words_of(t or b"")
            found = text_features(words, longest, memory)
            out[:, i] = len(words), len(found), gains[found].sum()
        return dict(zip(names, out))

    scored = map_arrow(rows, measure, dict.fromkeys(names[:3], "bigint"), keep=rows.columns[:-1])
    return scored.withColumn("score", F.col("weight") + hash_noise(id_col, seed))


def kth_key(rows: DataFrame, key: list[str], k: int, seed: int = 0) -> tuple | None:
    """The k-th smallest (from 1) composite key of ``rows``, whose keys differ; None where k is 0.

    Keys must not hold nulls. Every round is two scans that send at most ``PIVOTS`` keys and their
    counts to the driver.
    """
    if k <= 0:
        return None
    types = [rows.schema[c].dataType for c in key]
    place = F.struct(*key)

    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(values, types, key)])

    window, turn = rows, 0
    while True:
        turn += 1
        pivots = [tuple(r) for r in window.select(*key).orderBy(F.xxhash64(F.lit(seed + turn), *key)).limit(PIVOTS).collect()]
        if not pivots:
            raise ValueError("k is larger than the number of rows")
        counts = window.agg(*[F.count_if(place < literal(p)) for p in pivots], *[F.count_if(place <= literal(p)) for p in pivots]).first()
        below = None  # the nearest pivots around rank k, with the rows up to the lower one
        above = None
        for pivot, less, upto in zip(pivots, counts[: len(pivots)], counts[len(pivots):]):
            if less < k <= upto:
                return pivot
            if upto < k and (below is None or upto > below[1]):
                below = pivot, upto
            if less >= k and (above is None or less < above[1]):
                above = pivot, less
        if below:
            window, k = window.where(place > literal(below[0])), k - below[1]
        if above:
            window = window.where(place < literal(above[0]))


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", seed: int = 2024) -> DataFrame:
    """Append ``rank``: 1, 2, ... for the drawn rows by score, ties to the smaller id (null last); null for the others.

    floor(percent * N / 100) of the N rows with at least ``least_words`` words are drawn. Rows that
    repeat id and score are told apart by their place in the written table.
    """
    neg, none, some, row = (fresh(scored, n) for n in ("_neg", "_none", "_id", "_row"))
    kind = scored.schema[id_col].dataType
    stand_in = F.lit(0).cast(kind) if kind.typeName() != "string" else F.lit("")
    rows = materialize(scored.withColumns({
        neg: -F.col("score"), none: F.col(id_col).isNull(), some: F.coalesce(F.col(id_col), stand_in), row: F.monotonically_increasing_id()}))
    able = rows.where(F.col("n_words") >= least_words)
    last = kth_key(able.select(neg, none, some, row), [neg, none, some, row], percent * able.count() // 100, seed)
    if last is None:
        return rows.select(*scored.columns, F.lit(None).cast("bigint").alias("rank"))
    key = F.struct(neg, none, some, row)
    end = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for v, c in zip(last, (neg, none, some, row))])
    chosen = (F.col("n_words") >= least_words) & (key <= end)
    ranked, _ = number_rows(rows.where(chosen), [neg, none, some, row], "rank")
    rest = rows.where(~chosen).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", F.col("rank") + 1).unionByName(rest).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS,
             percent: int = 10, least_words: int = 20, seed: int = 2024, keep: list[str] | None = None) -> DataFrame:
    """Every document with n_words, n_features, weight, score and its rank in the draw towards ``target``.

    Null texts have no words, weight 0 and a score of noise alone; they are drawn only where
    ``least_words`` allows. Empty tables give no counts (documents) or gains from the documents alone
    (target). Columns of ``keep`` that are called like a result are replaced by it.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets))
    return draw(score_texts(docs, gains, id_col, text_col, longest, seed, [c for c in keep or [] if c != "rank"]), percent, least_words, id_col, seed)
