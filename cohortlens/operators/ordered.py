"""Ordered scans per key by one prefix scan over range partitions, whatever the keys hold.

Rows are dealt by ranges of (key, order) and sorted in them, so a key with most of the rows spans as
many partitions as its rows need, and rare keys share one. Each task scans its partition once and
adds the columns as far as the partition tells them; the result is written. Only the first and the
last key of a partition can go on in a neighbour. Their edge rows, at most four a partition, give
every partition's part of such a key; a window over these parts makes the carries, which meet the
written rows by partition number and key. Small and large, skewed and even inputs follow the same plan.

The written copy is what a query reads on from. Spark samples the input for the ranges before it deals
it out, so an input that is more than a scan of files is computed once, into a copy of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.session import discard, is_scan, materialize

#: Number of ranges; None leaves it to Spark, which merges small ones by their size.
RANGES: int | None = None
#: Rows of a range where that makes more ranges than there are cores: a task holds a key's rows in its range.
RANGE_ROWS = 500_000


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    position: str | None = None,
    size: str | None = None,
    running: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Append per-key ordered columns.

    ``position`` names a 1-based rank, ``size`` the row count of the key, ``running`` and
    ``totals`` map output names to summed columns (running sums include the own row; sums over nulls
    alone are null), ``lag`` and ``lead`` map output names to columns of the neighbour row. ``order``
    must be unique within a key; nulls come first. A null key is a key like any other. Sums of whole
    numbers are bigints, others doubles.
    """
    sums = {**(running or {}), **(totals or {})}
    steps = {**{o: (c, 1) for o, c in (lag or {}).items()}, **{o: (c, -1) for o, c in (lead or {}).items()}}
    own = df.columns
    source = df if is_scan(df) else materialize(df)
    dealt = source.repartitionByRange(*([n] if (n := ranges or RANGES or _ranges(source)) else []), *(keys + order)).sortWithinPartitions(*keys, *order)
    local = materialize(_scan_partitions(dealt, keys, sums, steps))
    if source is not df:
        discard(source)

    # parts of keys that may go on in another partition: one row per partition and key
    rest = {c: f"_scan_v_{i}" for i, c in enumerate(sorted({c for c, _ in steps.values()}))}
    place = Window.partitionBy(*keys).orderBy("_scan_part")  # one row per partition the key is found in
    parts = local.where("_scan_edge").groupBy("_scan_part", *keys).agg(
        F.max("_scan_n").alias("_scan_rows"), *[F.max_by(f"_scan_s_{o}", "_scan_at").alias(f"_scan_sum_{o}") for o in sums],
        *[F.min_by(c, "_scan_at").alias(f"{v}_first") for c, v in rest.items()], *[F.max_by(c, "_scan_at").alias(f"{v}_last") for c, v in rest.items()])
    before, whole = place.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    carries = parts.select(
        F.col("_scan_part").alias("_scan_c_part"), *[F.col(k).alias(f"_scan_c_key_{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_scan_rows").over(before), F.lit(0)).alias("_scan_before"), F.sum("_scan_rows").over(whole).alias("_scan_all"),
        *[F.sum(f"_scan_sum_{o}").over(before).alias(f"_scan_c_{o}") for o in running or {}],
        *[F.sum(f"_scan_sum_{o}").over(whole).alias(f"_scan_c_{o}") for o in totals or {}],
        *[(F.lag if step == 1 else F.lead)(f"{rest[c]}_{'last' if step == 1 else 'first'}").over(place).alias(f"_scan_c_{o}") for o, (c, step) in steps.items()])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_scan_c_key_{i}")) for i, k in enumerate(keys)], F.col("_scan_part") == F.col("_scan_c_part"))
    # at most two rows a partition
    joined = local.join(F.broadcast(carries), match, "left")

    cols: dict[str, Column] = {}
    if position:
        cols[position] = F.col("_scan_at") + F.coalesce("_scan_before", F.lit(0))
    if size:
        cols[size] = F.coalesce("_scan_all", "_scan_n")
    for o in running or {}:
        cols[o] = F.when(F.col(f"_scan_c_{o}").isNull(), F.col(f"_scan_r_{o}")).otherwise(F.col(f"_scan_c_{o}") + F.coalesce(F.col(f"_scan_r_{o}"), F.lit(0)))
    for o in totals or {}:
        cols[o] = F.coalesce(f"_scan_c_{o}", f"_scan_s_{o}")
    for o, (_, step) in steps.items():
        at_edge = F.col("_scan_at") == (F.lit(1) if step == 1 else F.col("_scan_n"))
        cols[o] = F.when(at_edge, F.col(f"_scan_c_{o}")).otherwise(F.col(f"_scan_l_{o}"))
    return joined.select(*own, *[c.alias(name) for name, c in cols.items()])


def _ranges(source: DataFrame) -> int | None:
    """Ranges of ``RANGE_ROWS`` rows; None while these are fewer than the cores."""
    n = source.count() // RANGE_ROWS
    return n if n > source.sparkSession.sparkContext.defaultParallelism else None


def _scan_partitions(dealt: DataFrame, keys: list[str], sums: dict[str, str], steps: dict[str, tuple[str, int]]) -> DataFrame:
    """Sorted partitions with their number, place and row count within the key, sums so far (``_scan_r_``) and in all
    (``_scan_s_``), neighbours (``_scan_l_``), and ``_scan_edge`` at the first and last row of the partition's first and last key.

    A task holds the rows of one key in its partition at a time.
    """
    own = dealt.columns
    whole = {o: isinstance(dealt.schema[c].dataType, T.IntegralType) for o, c in sums.items()}
    added = [("_scan_part", T.IntegerType()), ("_scan_at", T.LongType()), ("_scan_n", T.LongType()), ("_scan_edge", T.BooleanType())]
    for o in sums:
        kind = T.LongType() if whole[o] else T.DoubleType()
        added += [(f"_scan_r_{o}", kind), (f"_scan_s_{o}", kind)]
    added += [(f"_scan_l_{o}", dealt.schema[c].dataType) for o, (c, _) in steps.items()]
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(n, t) for n, t in added]])
    types = {n: to_arrow_type(t) for n, t in added}

    def scanned(rows: pa.Table, part: int, first: bool, last: bool) -> pa.RecordBatch:
        """Whole keys of a partition, in order."""
        rows = rows.combine_chunks()
        n = len(rows)
        start = np.flatnonzero(_changes(rows, keys))
        length = np.diff(np.append(start, n))
        begin, count = np.repeat(start, length), np.repeat(length, length)
        at = np.arange(n) - begin
        edge = np.zeros(n, bool)
        ends = [g for g, wanted in ((0, first), (len(start) - 1, last)) if wanted]
        for g in ends:
            edge[[start[g], start[g] + length[g] - 1]] = True
        out = {"_scan_part": np.full(n, part, np.int32), "_scan_at": at + 1, "_scan_n": count, "_scan_edge": edge}
        for o, c in sums.items():
            known = ~np.asarray(rows[c].is_null(nan_is_null=False))
            plain = np.where(known, rows[c].fill_null(0).to_numpy(), 0).astype(np.int64 if whole[o] else np.longdouble)
            run, seen = np.cumsum(plain), np.cumsum(known)
            odd = not whole[o] and not np.isfinite(run[-1:]).all()
            if odd:  # infinities and NaN must stay in their key
                run = np.concatenate([np.cumsum(p) for p in np.split(plain, start[1:])])
            behind = begin + count - 1
            base = 0 if odd else np.append(plain[:1] * 0, run)[begin]
            seen_base = np.append(0, seen)[begin]
            for name, i in ((f"_scan_r_{o}", np.arange(n)), (f"_scan_s_{o}", behind)):
                value = (run[i] - base).astype(np.int64 if whole[o] else np.float64)
                out[name] = pa.array(value, mask=seen[i] == seen_base)
        for o, (c, step) in steps.items():
            inside = at > 0 if step == 1 else at < count - 1
            out[f"_scan_l_{o}"] = pc.take(rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c], pa.array(np.arange(n) - step, mask=~inside))
        arrays = [*[rows[c] for c in own], *[out[name] if isinstance(out[name], pa.Array) else pa.array(out[name], types[name]) for name, _ in added]]
        return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            edge = pa.Table.from_batches([held[-2].slice(held[-2].num_rows - 1), batch]) if len(held) > 1 else pa.Table.from_batches([batch])
            change = np.flatnonzero(_changes(edge, keys))
            cut = int(change[-1]) - (len(held) > 1)  # last row of this batch that begins a key
            if len(change) > 1 and cut >= 0:
                done = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                if len(done):
                    yield scanned(done, part, first, False)
                    first = False
                held = [batch.slice(cut)]
        if held:
            yield scanned(pa.Table.from_batches(held), part, first, True)

    return dealt.mapInArrow(run, schema)


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """True at the first row and wherever a key column differs from the row before; nulls are equal."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for k in keys:
        column = rows[k].combine_chunks() if isinstance(rows[k], pa.ChunkedArray) else rows[k]
        now, was = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differ = pc.fill_null(pc.not_equal(now, was), False)
        out[1:] |= np.asarray(pc.or_(differ, pc.xor(now.is_null(), was.is_null())))
    return out


def value_histogram(df: DataFrame, columns: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Long table (variable, value, n, sums...) of the distinct values of numeric columns."""
    extra = sums or {}
    long = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns],
                  *[e.alias(f"_x_{name}") for name, e in extra.items()])
        .unpivot([f"_x_{name}" for name in extra], columns, "variable", "value")
        .where(F.col("value").isNotNull())
    )
    return long.groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"_x_{name}").alias(name) for name in extra],
    )


def mid_ranks(df: DataFrame, columns: list[str], **scan: object) -> DataFrame:
    """Average rank of every distinct value per variable: (variable, value, n, mid_rank)."""
    hist = value_histogram(df, columns)
    cum = ordered_scan(hist, ["variable"], ["value"], running={"_cum": "n"}, **scan)
    return cum.select("variable", "value", "n", (F.col("_cum") - F.col("n") + (F.col("n") + 1) / 2).alias("mid_rank"))
