"""Exact Shapley values of boosted trees against background rows, without walking coalitions.

A leaf is reached by a mix of an explained and a background row if every feature on its path takes its
value from a row that meets the feature's conditions there. So a leaf's share for a feature follows
from two bit masks alone: which of the path's features the explained row meets, and which the
background row. The background is compiled once per model: for every leaf the few masks that occur
in it, with the background rows that have them. Per Arrow batch, a leaf costs one mask (a byte) per row and a
lookup in a small table for each of its features and background masks, taken for all rows at once; there is
no row per background row or step.

On the margin scale the background's masks are averaged beforehand. On the probability scale each
pair of rows has its own factor, the change in probability over the change in margin, so the
factors' sums per mask come from one matrix product with the batch. Both are exact: base + sum of
contributions is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.boosting import Model, Tree, _matrix, column_margins, sigmoid
from cohortlens.session import spread

#: Rows explained at a time.
STEP = 2_048
#: Factor sums (masks of leaves) of one matrix product.
MASKS = 1_024


@dataclass
class Leaf:
    """Value and, per distinct feature of its path, the half-open range of bins that leads there."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def masks(self, columns: np.ndarray) -> np.ndarray:
        """Bit i is set where a row (a column of features x rows of bins) meets the conditions of the i-th feature."""
        out = np.zeros(columns.shape[1], np.uint8 if len(self.features) <= 8 else np.int64)
        for i, f in enumerate(self.features):
            meets = columns[f] >= np.uint8(self.low[i]) if self.low[i] < 256 else np.zeros(len(out), bool)
            if self.high[i] < 256:
                meets = meets & (columns[f] < np.uint8(self.high[i]))
            out |= meets.astype(out.dtype) << i
        return out


def leaves_of(tree: Tree) -> list[Leaf]:
    """Leaves with a value and at least one feature."""
    out, todo = [], [(0, {})]
    while todo:
        node, ranges = todo.pop()
        f = int(tree.feature[node])
        if f < 0:
            if ranges and tree.value[node]:
                names = sorted(ranges)
                out.append(Leaf(float(tree.value[node]), np.array(names), np.array([ranges[n][0] for n in names]), np.array([ranges[n][1] for n in names])))
            continue
        low, high = ranges.get(f, (0, 257))
        cut = int(tree.cut[node])
        if cut > low:
            todo.append((2 * node + 1, {**ranges, f: (low, min(high, cut))}))
        if cut < high:
            todo.append((2 * node + 2, {**ranges, f: (max(low, cut), high)}))
    return out


@lru_cache(maxsize=None)
def shares(n: int) -> np.ndarray:
    """(explained mask, background mask, feature): Shapley share of a leaf of value one with n features."""
    full = (1 << n) - 1
    out = np.zeros((full + 1, full + 1, n))
    for a in range(full + 1):
        for b in range(full + 1):
            if a | b != full:
                continue
            only_a, only_b = a & ~b, b & ~a
            p, q = only_a.bit_count(), only_b.bit_count()
            for i in range(n):
                if only_a >> i & 1:
                    out[a, b, i] = factorial(p - 1) * factorial(q) / factorial(p + q)
                elif only_b >> i & 1:
                    out[a, b, i] = -factorial(p) * factorial(q - 1) / factorial(p + q)
    return out


class Explainer:
    """A model with its background compiled to leaf masks."""

    def __init__(self, model: Model, background: np.ndarray, probability: bool = True) -> None:
        """``background``: rows x features of values."""
        self.model, self.probability = model, probability
        bins = np.ascontiguousarray(model.bins_of(background).T)
        self.margin = model.base + column_margins(model.trees, bins)
        self.base = float(sigmoid(self.margin).mean() if probability else self.margin.mean())
        self.leaves = []
        for tree in model.trees:
            for leaf in leaves_of(tree):
                seen, which = np.unique(leaf.masks(bins), return_inverse=True)
                has = (np.arange(len(seen))[:, None] == which) / bins.shape[1]  # mask x background row
                table = leaf.value * shares(len(leaf.features))[:, seen]
                self.leaves.append((leaf, np.ascontiguousarray(table.transpose(2, 1, 0)), has))  # feature x background mask x mask

    def explain(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, contributions: rows x features)."""
        bins = np.ascontiguousarray(self.model.bins_of(values).T)
        margin = self.model.base + column_margins(self.model.trees, bins)
        phi = np.zeros(bins.shape)
        if not self.probability:
            for leaf, table, has in self.leaves:
                part = np.einsum("fja,j->fa", table, has.sum(1))[:, leaf.masks(bins)]
                for i, f in enumerate(leaf.features):
                    phi[f] += part[i]
            return margin, phi.T
        gap = margin - self.margin[:, None]
        p = sigmoid(margin)
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = (p - sigmoid(self.margin)[:, None]) / gap
        factor = np.where(np.abs(gap) < 1e-9, p * (1 - p), factor)
        first = 0
        while first < len(self.leaves):
            last, width = first, 0
            while last < len(self.leaves) and (width == 0 or width + len(self.leaves[last][2]) <= MASKS):
                width += len(self.leaves[last][2])
                last += 1
            sums = np.concatenate([has for _, _, has in self.leaves[first:last]]) @ factor
            at = 0
            for leaf, table, has in self.leaves[first:last]:
                mask = leaf.masks(bins).astype(np.intp)
                weight = sums[at: at + len(has)]
                at += len(has)
                for f, shares_ in zip(leaf.features, table):
                    phi[f] += np.einsum("jr,jr->r", shares_.take(mask, 1, mode="clip"), weight)  # no mask is out of range
            first = last
        return p, phi.T


def tree_contributions(rows: DataFrame, key: str, model: Model, background: np.ndarray, probability: bool = True) -> DataFrame:
    """(key, base, p, phi) of every row of (key, features: array of doubles): base + sum(phi) = p.

    ``p`` is the probability, or the margin where ``probability`` is false. The model and the
    background (a bounded number of rows, stated by the caller) travel to the workers; rows stay
    where they are.
    """
    explainer: list[Explainer] = []
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not explainer:
            explainer.append(Explainer(model, background, probability))
        for batch in batches:
            values = _matrix(batch.column(1), len(model.cuts))
            # rows in the same bins have the same contributions
            _, some, which = np.unique(_row_bytes(model.bins_of(values)), return_index=True, return_inverse=True)
            distinct = [explainer[0].explain(values[some[i: i + STEP]]) for i in range(0, len(some), STEP)]
            scores, shares_ = (np.concatenate(c) for c in zip(*distinct)) if distinct else (None, None)
            for i in range(0, batch.num_rows, STEP):
                part, at = batch.slice(i, STEP), which[i: i + STEP]
                p, phi = scores[at], shares_[at]
                ends = pa.array(np.arange(len(phi) + 1, dtype=np.int32) * phi.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(p), explainer[0].base)), pa.array(p),
                                                  pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))], names=[key, "base", "p", "phi"])

    return spread(rows.select(key, "features")).mapInArrow(run, f"`{key}` {kind}, base double, p double, phi array<double>")


def _row_bytes(bins: np.ndarray) -> np.ndarray:
    """Every row as one value that can be compared."""
    return np.ascontiguousarray(bins).view(np.dtype((np.void, max(1, bins.shape[1])))).ravel() if bins.shape[1] else np.zeros(len(bins))


def background_rows(rows: DataFrame, n: int = 100) -> np.ndarray:
    """Feature values of at most ``n`` rows of a sample, as a matrix."""
    found = rows.select(F.col("features")).limit(n).collect()
    return np.array([r["features"] for r in found], float).reshape(len(found), -1)
