"""K-means for many numbers of clusters and restarts in the same passes over the rows.

Executors keep the rows as blocks. A pass meets every row with the centres of all models at once (one
matrix product a step) and adds up sums and counts per centre over a tree of tasks; the driver holds
centres only. Models that no longer move drop out. The silhouette is that of squared distances, which
follows exactly from sums per cluster, so one more pass scores every row under all models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, types as T

from cohortlens.operators.boosting import _matrix, summed
from cohortlens.operators.folds import SEED, hash_sample
from cohortlens.session import spread

STEP = 8_192
#: Rows the first centres are drawn from, by the usual rule of squared distances.
START_ROWS = 2_000


@dataclass
class Clusters:
    """Centres of one model with the sum of squared distances to them and its silhouette."""

    k: int
    restart: int
    centres: np.ndarray
    cost: float = float("inf")
    silhouette: float = float("nan")


def row_blocks(vectors: DataFrame, column: str = "features") -> RDD:
    """The vectors (arrays of doubles, equally long, without nulls) as matrices, kept by the executors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                width = len(batch.column(0)[0])
                yield pa.RecordBatch.from_arrays([pa.array([width]), pa.array([_matrix(batch.column(0), width).tobytes()])], names=["width", "x"])

    packed = spread(vectors.select(column)).mapInArrow(pack, "width bigint, x binary")
    return packed.rdd.map(lambda r: np.frombuffer(r["x"], np.float64).reshape(-1, r["width"])).persist(StorageLevel.MEMORY_AND_DISK)


def _tree_sum(blocks: RDD, of: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    def run(held: Iterator[np.ndarray]) -> Iterator[list[np.ndarray] | None]:
        total = None
        for x in held:
            for i in range(0, len(x), STEP):
                part = of(x[i: i + STEP])
                total = part if total is None else [a + b for a, b in zip(total, part)]
        yield total

    def add(a: list | None, b: list | None) -> list | None:
        return b if a is None else a if b is None else [x + y for x, y in zip(a, b)]

    return summed(blocks.mapPartitions(run), add)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _members(x: np.ndarray, models: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per model the cluster of each row and its squared distance."""
    far = _squared(x, np.concatenate(models))
    first = 0
    for centres in models:
        own = far[:, first: first + len(centres)]
        first += len(centres)
        at = own.argmin(1)
        yield at, own[np.arange(len(x)), at]


def first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows drawn one after the other with a chance in proportion to the squared distance to those drawn."""
    chosen = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        far = _squared(sample, np.array(chosen)).min(1)
        chosen.append(sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))])
    return np.array(chosen)


def fit_clusters(vectors: DataFrame, key: str, ks: list[int], restarts: int = 10, seed: int = SEED, iterations: int = 100,
                 tolerance: float = 1e-4) -> list[Clusters]:
    """Every model of every ``k`` and restart, with cost and silhouette over all rows of (key, features).

    A cluster that loses all rows keeps its centre. The silhouette counts a row alone in its cluster as
    0; with a single cluster it is not defined. No rows give no models.
    """
    sample = np.array([r["features"] for r in hash_sample(vectors, key, START_ROWS, seed).select("features").collect()])
    if not len(sample):
        return []
    order = np.lexsort(sample.T)  # whatever order the rows came in
    models = [Clusters(k, r, first_centres(sample[order], k, np.random.default_rng([seed, k, r]))) for k in ks for r in range(restarts)]
    blocks = row_blocks(vectors)
    moving = list(models)
    for _ in range(iterations):
        if not moving:
            break
        centres = [m.centres for m in moving]

        def sums(x: np.ndarray) -> list[np.ndarray]:
            out = []
            for (at, _), c in zip(_members(x, centres), centres):
                member = (at[:, None] == np.arange(len(c))).astype(float)
                out.append(np.concatenate([member.T @ x, member.sum(0)[:, None]], 1))
            return out

        still = []
        for m, total in zip(moving, _tree_sum(blocks, sums)):
            n = total[:, -1:]
            new = np.where(n > 0, total[:, :-1] / np.maximum(n, 1), m.centres)
            moved = ((new - m.centres) ** 2).sum(1).max()
            m.centres = new
            if moved > tolerance ** 2:
                still.append(m)
        moving = still
    _measure(blocks, models)
    blocks.unpersist()
    return models


def _measure(blocks: RDD, models: list[Clusters]) -> None:
    """Cost, then silhouette, of all models: two passes."""
    centres = [m.centres for m in models]

    def facts(x: np.ndarray) -> list[np.ndarray]:
        out = []
        for (at, far), c in zip(_members(x, centres), centres):
            member = (at[:, None] == np.arange(len(c))).astype(float)
            out.append(np.concatenate([member.T @ x, member.T @ np.stack([np.ones(len(x)), (x * x).sum(1), far], 1)], 1))
        return out

    known = _tree_sum(blocks, facts)  # per cluster: sum of rows, rows, sum of squared norms, cost

    def widths(x: np.ndarray) -> list[np.ndarray]:
        norm, each, out = (x * x).sum(1), np.arange(len(x)), []
        for (at, _), total in zip(_members(x, centres), known):
            n = total[:, -3]
            # mean squared distance to all rows of a cluster
            mean = norm[:, None] + (total[:, -2] - 2 * x @ total[:, :-3].T) / np.maximum(n, 1)
            own = mean[each, at] * n[at] / np.maximum(n[at] - 1, 1)  # without the row itself
            mean[each, at] = np.inf
            mean[:, n == 0] = np.inf
            other = mean.min(1) if mean.shape[1] > 1 else np.full(len(x), np.nan)
            top = np.maximum(np.maximum(own, other), 1e-300)
            out.append(np.array([np.where(n[at] > 1, (other - own) / top, np.where(np.isnan(other), np.nan, 0.0)).sum(), len(x)]))
        return out

    for m, total, (width, n) in zip(models, known, _tree_sum(blocks, widths)):
        m.cost, m.silhouette = float(total[:, -1].sum()), float(width / n)


def assign(vectors: DataFrame, model: Clusters, output: str = "cluster") -> DataFrame:
    """Add the number of the nearest centre; equal distances take the lower number."""
    centres = [model.centres]
    names = vectors.columns
    at = names.index("features")
    schema = T.StructType([*vectors.schema.fields, T.StructField(output, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, _ = next(_members(_matrix(batch.column(at), centres[0].shape[1]), centres))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=[*names, output])

    return vectors.mapInArrow(run, schema)


def best(models: list[Clusters], k: int) -> Clusters:
    """The model of ``k`` clusters with the lowest cost; equal ones by the earlier restart."""
    return min((m for m in models if m.k == k), key=lambda m: (m.cost, m.restart))
