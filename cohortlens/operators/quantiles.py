"""Exact quantiles by narrowing brackets: a sketch says where an order statistic lies, counting says which it is.

The first pass takes an approximate-percentile sketch per column, which tasks build and Spark merges,
and gives two values around every wanted ordinal. The next pass counts exactly how many rows lie
below and at both values. So the ordinal is one of them, or lies strictly between, below or above, and
that open bracket is sketched and counted again. Both values are values of rows inside the bracket, so
every round makes it smaller, by about a hundredfold: two or three rounds settle any input. The rows
of a bracket that holds at most ``limit`` are counted by value and fetched. Only sketches, counts and
at most that many rows a bracket ever leave the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.session import discard, is_scan, materialize

#: Rows of a bracket that are fetched.
LIMIT = 2_000
#: Accuracy of the sketches: ranks are wrong by one part in this many.
ACCURACY = 10_000
#: Inner points of a bracket that is sketched again.
GRID = 200


@dataclass
class _Bracket:
    """An ordinal (from 0) of a column whose value lies strictly between two values; ``below`` rows are at or under the lower one."""

    column: str
    ordinal: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    pivots: tuple[float, float] = (0.0, 0.0)

    def holds(self) -> Column:
        c = F.col(self.column)
        return c.isNotNull() & (F.lit(True) if self.low is None else c > self.low) & (F.lit(True) if self.high is None else c < self.high)

    def narrow(self, less: list[int], upto: list[int]) -> float | None:
        """Take the rows below and at each pivot into account; the value where a pivot is it."""
        for pivot, under, at in zip(self.pivots, less, upto):
            if under <= self.ordinal < at:
                return pivot
            if self.ordinal < under:
                self.high, self.inside = pivot, under - self.below
                return None
            if at > self.below:
                self.inside -= at - self.below
                self.low, self.below = pivot, at
        return None


def order_statistics(df: DataFrame, wanted: dict[str, list[float]], limit: int = LIMIT) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """Non-null counts per column, and values at the ordinals (from 0) around every wanted share of (n - 1)."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in wanted])
    base = rows if is_scan(rows) else materialize(rows)
    step = 2 / ACCURACY
    points = {c: sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-step, step)}) for c, ps in wanted.items()}
    first = _row(base, [F.count(c).alias(f"n_{i}") for i, c in enumerate(wanted)]
                 + [F.percentile_approx(c, points[c], ACCURACY).alias(f"q_{i}") for i, c in enumerate(wanted)])
    sizes, found, open_ = {}, {}, {}
    for i, (c, shares) in enumerate(wanted.items()):
        sizes[c] = n = first[f"n_{i}"]
        sketch = dict(zip(points[c], first[f"q_{i}"] or []))
        for p in shares if n else []:
            for ordinal in (math.floor((n - 1) * p), math.ceil((n - 1) * p)):
                open_[c, ordinal] = _Bracket(c, ordinal, n, pivots=(sketch[max(0.0, p - step)], sketch[min(1.0, p + step)]))
    few: list[_Bracket] = []
    open_ = list(open_.values())
    while open_:
        counts = _counts(base, open_)
        rest = []
        for i, b in enumerate(open_):
            value = b.narrow(*counts[i])
            if value is not None:
                found[b.column, b.ordinal] = value
            else:
                (few if b.inside <= limit else rest).append(b)
        open_ = rest
        if open_:
            grids = _row(base, [F.percentile_approx(F.when(b.holds(), F.col(b.column)), [j / GRID for j in range(GRID + 1)], ACCURACY).alias(f"g_{i}")
                                for i, b in enumerate(open_)])
            for i, b in enumerate(open_):
                place = (b.ordinal - b.below) / b.inside * GRID
                b.pivots = grids[f"g_{i}"][max(0, math.floor(place) - 1)], grids[f"g_{i}"][min(GRID, math.ceil(place) + 1)]
    found.update(_fetched(base, few))
    if base is not rows:
        discard(base)
    return sizes, found


def _row(df: DataFrame, aggregates: list[Column]) -> dict:
    return df.agg(*aggregates).first().asDict()


def _counts(base: DataFrame, brackets: list[_Bracket]) -> list[list[list[int]]]:
    """Per bracket the rows below each of its pivots, and those at or below it; tasks send sums only."""
    columns = {c: i for i, c in enumerate(base.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(brackets), 4), np.int64)
        for batch in batches:
            values = {c: np.sort(batch.column(i).drop_null().to_numpy()) for c, i in columns.items()}  # NaN is last
            for i, b in enumerate(brackets):
                total[i] += [*np.searchsorted(values[b.column], b.pivots, "left"), *np.searchsorted(values[b.column], b.pivots, "right")]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(brackets)), 4)), pa.array(np.tile(np.arange(4), len(brackets))), pa.array(total.ravel())],
                                         names=["b", "j", "n"])

    out = [[[0, 0], [0, 0]] for _ in brackets]
    for i, j, n in base.mapInArrow(run, "b bigint, j bigint, n bigint").groupBy("b", "j").agg(F.sum("n")).collect():
        out[i][j // 2][j % 2] = n
    return out


def _fetched(base: DataFrame, few: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Values of brackets whose few rows are counted by value and sorted here."""
    if not few:
        return {}
    columns = {c: i for i, c in enumerate(base.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sorted_ = {c: np.sort(batch.column(i).drop_null().to_numpy()) for c, i in columns.items()}
            for i, b in enumerate(few):
                held = sorted_[b.column]
                first = 0 if b.low is None else np.searchsorted(held, b.low, "right")
                last = len(held) if b.high is None else np.searchsorted(held, b.high, "left")
                if last > first:
                    value, n = np.unique(held[first:last], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i)), pa.array(value), pa.array(n)], names=["b", "v", "n"])

    hits = base.mapInArrow(run, "b bigint, v double, n bigint").groupBy("b", "v").agg(F.sum("n").alias("n"))
    out, upto = {}, {i: b.below for i, b in enumerate(few)}
    for i, value, n in sorted(hits.collect(), key=lambda r: (r[0], math.isnan(r[1]), r[1])):  # at most `limit` rows a bracket
        b = few[i]
        if upto[i] <= b.ordinal < upto[i] + n:
            out[b.column, b.ordinal] = value
        upto[i] += n
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], limit: int = LIMIT) -> DataFrame:
    """Exact linearly interpolated quantiles per column: (variable, q array in probs order).

    Nulls are left out, NaN counts as the largest value; a column without values has no row.
    """
    sizes, values = order_statistics(df, {c: probs for c in columns}, limit)
    rows = []
    for c in columns:
        if sizes[c]:
            at = [(sizes[c] - 1) * p for p in probs]
            ends = [(values[c, math.floor(x)], values[c, math.ceil(x)], x - math.floor(x)) for x in at]
            rows.append((c, [low if low == high else low + (high - low) * share for low, high, share in ends]))
    return df.sparkSession.createDataFrame(rows, "variable string, q array<double>")
