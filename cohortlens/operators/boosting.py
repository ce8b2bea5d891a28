"""Boosted trees on pre-binned columns; many models (folds, feature sets) grow in the same passes over the rows.

A row belongs to one model and is one of its training rows or one of its held-out rows. Features are
binned once, a byte each, and written; training rows are packed into blocks of one model each, which
the executors keep. One pass grows one level of one tree of every model: tasks walk their blocks down
the trees and sum gradients and second derivatives per (model, node, feature bin); these arrays are
added up in the tasks first and then over a tree of tasks. The driver sees sums only: models
times nodes of a level times bins, whatever the rows. Every ``FLUSH`` rounds the blocks get the
margins of the trees since; every ``RENEW`` of those times they are made from the first blocks again, so a
lost one is a few steps away from the written table. In between a pass adds the few newer trees itself.
Models of at most ``ALONE`` training rows grow in one task each, by the same steps.

Sums go by joint codes: features whose numbers of bins multiply to at most ``CODES`` share one number, a row
adds to its place once per code instead of once per feature, and the sums of a feature's bins are sums over
codes. Of the two children of a split only the lighter one is added up; the other is what is left of the split node.

The passes are the one place of this package that works on an RDD: a tree reduction of arrays, repeated
rounds times depth, whose fixed cost a query plan would multiply.

Splits are those of second-order boosting for the logistic loss: gain and leaf values from sums of
gradients G and second derivatives H with a penalty on leaf values, -G / (H + l2), both children
with at least ``least_weight`` of H. The first margin is the log odds of the training rows. Rows are
sampled per tree by a hash of their key, columns by a seeded draw. Nulls count as the smallest value.
Equal gains take the first feature in order and the lowest cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators.folds import SEED, key_hash
from cohortlens.session import discard, materialize

#: Rounds after which the blocks get new margins, and how many times until these come from all trees again.
FLUSH, RENEW = 2, 50
#: Tasks whose sums the driver adds itself; those of more go over a tree of tasks.
FEW_TASKS = 32
#: Rows of one block, of a task's least share, and of one numpy step.
BLOCK, STEP, WALK = 1 << 18, 4_096, 1 << 15
#: Training rows, and bytes of their bins, of a model that grows in one task: its sums need no adding up, and the jobs
#: of all levels would cost more than the levels themselves. Larger models grow in passes over the blocks of all tasks.
ALONE, ALONE_BYTES = 1 << 20, 1 << 27
#: Values of a joint code of several features.
CODES = 1_024
#: Levels up to which a tree's conditions are all taken, as bytes; rows of deeper trees are walked down one by one.
FLAT = 6


@dataclass(frozen=True)
class Settings:
    rounds: int = 400
    depth: int = 4
    rate: float = 0.05
    l2: float = 1.0
    least_weight: float = 5.0
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 256
    seed: int = SEED


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2 i + 1 (bin below ``cut``) and 2 i + 2; ``feature`` -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of every row (rows x features) after so many levels."""
        node = np.zeros(len(bins), np.int64)
        each = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[node]
            right = bins[each, np.maximum(f, 0)] >= self.cut[node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return node


@dataclass
class Model:
    """Cut points per feature (a value's bin is the number of cuts at or below it), first margin and trees."""

    cuts: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def starts(self) -> np.ndarray:
        """First place of every feature's bins in one array of all bins, and its length."""
        return np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])])

    def bins_of(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape, np.uint8)
        for i, cuts in enumerate(self.cuts):
            v = values[:, i]
            out[:, i] = np.searchsorted(cuts, np.where(np.isnan(v), -np.inf, v), side="right")
        return out


def _complete(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and value of the tree with every leaf at the lowest level: a row at a higher one goes right down to it."""
    feature, cut, value = tree.feature.copy(), tree.cut.copy(), tree.value.copy()
    for i in range(len(feature) // 2):
        if feature[i] < 0:
            feature[i], cut[i], feature[2 * i + 2], value[2 * i + 2] = 0, 0, -1, value[i]
    return feature, cut, value


def _reach(feature: np.ndarray, cut: np.ndarray, columns: np.ndarray, levels: int) -> np.ndarray:
    """Place within its level (a byte) that every column of bins (features x rows) gets to in a complete tree: all
    conditions of a level are taken for all rows, then the path's bits choose among them."""
    path: list[np.ndarray] = []
    for level in range(levels):
        found = [(columns[feature[i]] >= np.uint8(cut[i])).view(np.uint8) for i in range((1 << level) - 1, (1 << level + 1) - 1)]
        for bit in reversed(path):
            found = [a ^ (bit & (a ^ b)) for a, b in zip(found[::2], found[1::2])]
        path += found
    out = np.zeros(columns.shape[1], np.uint8)
    for bit in path:
        out = out << 1 | bit
    return out


def margins(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for every row of bins."""
    return column_margins(trees, bins.T)


def column_margins(trees: list[Tree], columns: np.ndarray) -> np.ndarray:
    """The same of features x rows."""
    out = np.zeros(columns.shape[1])
    if not len(columns):
        return out + sum(tree.value[0] for tree in trees)
    ready = [(int(math.log2(len(tree.value) + 1)) - 1, tree, *_complete(tree)) for tree in sorted(trees, key=lambda tree: len(tree.value))]
    for i in range(0, len(out), WALK):
        part, sums = np.ascontiguousarray(columns[:, i: i + WALK]), out[i: i + WALK]
        for levels, tree, feature, cut, value in ready:
            if levels > FLAT:
                sums += tree.value[tree.places(part.T, levels)]
            else:
                sums += value[(1 << levels) - 1:][_reach(feature, cut, part, levels)]
    return out


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


def _mixed(u: np.ndarray, round_: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row hashes, another draw each round."""
    with np.errstate(over="ignore"):
        z = u.astype(np.uint64) + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)) / 2.0**64


class Codes:
    """Joint codes of some features: each group's product of bins is at most ``CODES`` (or it is one feature)."""

    def __init__(self, first: np.ndarray, features: np.ndarray) -> None:
        """``first``: first place of every feature's bins among all, and their number."""
        sizes = np.diff(first)
        self.first, self.groups = first, []
        held: list[tuple[int, list[int]]] = []
        for f in sorted(features.tolist(), key=lambda f: (-sizes[f], f)):
            at = next((i for i, (n, _) in enumerate(held) if n * sizes[f] <= CODES), len(held))
            n, some = held[at] if at < len(held) else (1, [])
            held[at: at + 1] = [(int(n * sizes[f]), [*some, f])]
        self.total = 0
        for n, some in held:
            steps = np.cumprod([1, *sizes[some[:-1]]]).tolist()
            of = np.concatenate([(np.arange(n) // step % sizes[f])[:, None] == np.arange(sizes[f]) for f, step in zip(some, steps)], 1).astype(float)
            to = np.concatenate([np.arange(first[f], first[f + 1]) for f in some])
            self.groups.append((slice(self.total, self.total + n), n, some, steps, of, to))
            self.total += n

    def of(self, columns: np.ndarray) -> list[np.ndarray]:
        """Each group's code of every row, from features x rows."""
        out = []
        for _, _, some, steps, _, _ in self.groups:
            code = columns[some[0]].astype(np.uint16)
            for f, step in zip(some[1:], steps[1:]):
                code += columns[f] * np.uint16(step)
            out.append(code)
        return out

    def add(self, own: np.ndarray, codes: list[np.ndarray], node: np.ndarray | None, weights: tuple[np.ndarray, ...]) -> None:
        """Add the weights of rows to ``own`` (nodes x weights x codes); ``node`` is None where there is one."""
        for (place, n, *_), code in zip(self.groups, codes):
            at = code.astype(np.int64) if node is None else code + node * n
            for j, weight in enumerate(weights):
                own[:, j, place] += np.bincount(at, weight, len(own) * n).reshape(len(own), n)

    def bins(self, own: np.ndarray) -> np.ndarray:
        """Sums by code (... x codes) as sums by bin of every feature (... x bins)."""
        out = np.zeros((*own.shape[:-1], int(self.first[-1])))
        for place, _, _, _, of, to in self.groups:
            out[..., to] = own[..., place] @ of
        return out


def find_cuts(rows: DataFrame, settings: Settings) -> dict[str, Model]:
    """Cut points and first margin per model, from its training rows: between all distinct values of a feature
    with at most ``bins`` of them, else at quantiles."""
    train = rows.where("train")
    found = {r["model"]: r for r in train.groupBy("model").agg(F.avg(F.col("label").cast("double")).alias("rate"), F.max(F.size("features")).alias("w")).collect()}
    if not found:
        return {}
    few = _distinct_values(train, max(r["w"] for r in found.values()), settings.bins)
    many = sorted({i for name, r in found.items() for i in range(r["w"]) if (name, i) not in few})
    probs = [i / settings.bins for i in range(settings.bins)] + [1.0]
    quantiles = {}
    if many:
        wide = [F.percentile_approx(F.get("features", F.lit(i)), probs, 20 * settings.bins).alias(f"q{i}") for i in many]
        quantiles = {r["model"]: r for r in train.groupBy("model").agg(*wide).collect()}  # one row a model
    models = {}
    for name, r in found.items():
        rate = min(max(r["rate"], 1e-6), 1 - 1e-6)
        values = [few[name, i] if (name, i) in few else np.unique(np.array(quantiles[name][f"q{i}"] or [], float)) for i in range(r["w"])]
        models[name] = Model([v[1:settings.bins] for v in values], math.log(rate / (1 - rate)))
    return models


def _distinct_values(train: DataFrame, width: int, most: int) -> dict[tuple[str, int], np.ndarray]:
    """(model, feature) -> its sorted values, for features with at most ``most`` of them; a task gives up on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], np.ndarray | None] = {}
        for batch in batches:
            names, values = np.array(batch.column(0).to_pylist(), object), _matrix(batch.column(1), width)
            for name in set(names):
                mine = values[names == name]
                for i in range(width):
                    known = seen.get((name, i), np.zeros(0))
                    if known is not None:
                        known = np.union1d(known, mine[~np.isnan(mine[:, i]), i])
                        seen[name, i] = known if len(known) <= most else None
        out = [(name, i, v) for (name, i), known in seen.items() for v in ([None] if known is None else known.tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.float64()))], names=["model", "feature", "value"])

    each = materialize(train.select("model", "features").mapInArrow(run, "model string, feature int, value double").distinct())
    sized = each.groupBy("model", "feature").agg(F.max(F.col("value").isNull()).alias("over"), F.count("value").alias("n"))
    kept = each.join(sized.where(~F.col("over") & (F.col("n") <= most)), ["model", "feature"]).groupBy("model", "feature").agg(
        F.array_sort(F.collect_list("value")).alias("values"))
    out = {(r["model"], r["feature"]): np.array(r["values"]) for r in kept.collect()}  # at most `most` values a feature
    discard(each)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows x ``width``, null entries as NaN; shorter lists are padded."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.full((len(column), width), np.nan)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _binned(rows: DataFrame, models: dict[str, Model], key: str, settings: Settings) -> DataFrame:
    """(model, key, label, train, u, bins), written once."""
    width = max((len(m.cuts) for m in models.values()), default=0)
    source = rows.select("model", key, F.col("label").cast("double").alias("label"), "train", key_hash(key, settings.seed).alias("u"), "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(5), width)
            names = np.array(batch.column(0).to_pylist(), object)
            bins = np.zeros(values.shape, np.uint8)
            for name in set(names):
                mine, model = names == name, models[name]
                bins[mine, : len(model.cuts)] = model.bins_of(values[mine][:, : len(model.cuts)])
            packed = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], packed], names=["model", key, "label", "train", "u", "bins"])

    kind = rows.schema[key].dataType.simpleString()
    return materialize(source.mapInArrow(run, f"model string, `{key}` {kind}, label double, train boolean, u bigint, bins binary"))


@dataclass
class _Block:
    """Training rows of one model; their bins are features x rows."""

    model: str
    bins: np.ndarray
    label: np.ndarray
    u: np.ndarray
    margin: np.ndarray


def _blocks(binned: DataFrame, models: dict[str, Model]) -> RDD:
    """The training rows as blocks, kept by the executors."""
    width = max(len(m.cuts) for m in models.values())
    base = {name: m.base for name, m in models.items()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}

        def out(name: str) -> pa.RecordBatch:
            joined = [b"".join(parts) for parts in zip(*held.pop(name))]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, *joined)], names=["model", "bins", "label", "u"])

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            label, u, bins = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3), width)
            for name in set(names):
                mine = names == name
                held.setdefault(name, []).append((bins[mine].tobytes(), label[mine].tobytes(), u[mine].tobytes()))
                if sum(len(u) for _, _, u in held[name]) >= 8 * BLOCK:
                    yield out(name)
        for name in list(held):
            yield out(name)

    def block(r) -> _Block:
        label = np.frombuffer(r["label"], np.float64)
        bins = np.ascontiguousarray(np.frombuffer(r["bins"], np.uint8).reshape(len(label), width).T)
        return _Block(r["model"], bins, label.astype(np.uint8), np.frombuffer(r["u"], np.int64), np.full(len(label), base[r["model"]]))

    train = binned.where("train").select("model", "label", "u", "bins")
    n, cores = train.count(), binned.sparkSession.sparkContext.defaultParallelism
    # a pass costs rows times features, so few bytes are no reason for few tasks
    dealt = train.repartition(max(1, min(n // STEP, cores), n // (8 * BLOCK)))
    packed = dealt.mapInArrow(pack, "model string, bins binary, label binary, u binary")
    return packed.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def _level_sums(blocks: RDD, starts: dict[str, np.ndarray], newer: dict[str, list[Tree]], growing: dict[str, Tree], used: dict[str, np.ndarray],
                level: int, round_: int, share: float, wanted: dict[str, list[int]]) -> dict[tuple[str, int], np.ndarray]:
    """(model, node) -> gradients and second derivatives per bin (2 x bins) of the wanted nodes of a level, over the sampled rows."""

    def run(held: Iterator[_Block]) -> Iterator[dict[tuple[str, int], np.ndarray]]:
        sums: dict[str, tuple[Codes, np.ndarray]] = {}
        for block in held:
            name = block.model
            if wanted[name]:
                if name not in sums:
                    codes = Codes(starts[name], used[name])
                    sums[name] = codes, np.zeros((len(wanted[name]), 2, codes.total))
                _add_sums(*sums[name], block, newer[name], growing[name], level, wanted[name], round_, share)
        done = {name: codes.bins(own) for name, (codes, own) in sums.items()}
        yield {(name, node): own[k] for name, own in done.items() for k, node in enumerate(wanted[name]) if own[k, 1].any()}

    def add(a: dict, b: dict) -> dict:
        for place, more in b.items():
            a[place] = a[place] + more if place in a else more
        return a

    return summed(blocks.mapPartitions(run), add)


def _add_sums(codes: Codes, own: np.ndarray, block: _Block, newer: list[Tree], tree: Tree, level: int, wanted: list[int], round_: int, share: float) -> None:
    """Add the sampled rows' gradients and second derivatives to ``own`` (wanted nodes x 2 x codes)."""
    low = (1 << level) - 1
    number = np.full((1 << level + 1) - 1, -1)
    number[wanted] = np.arange(len(wanted))
    feature, cut, _ = _complete(tree)
    for i in range(0, len(block.u), WALK):
        bins = np.ascontiguousarray(block.bins[:, i: i + WALK])
        # a row at a leaf above stays there or goes on to places below it, none of which is wanted
        node = number[tree.places(bins.T, level) if level > FLAT else low + _reach(feature, cut, bins, level).astype(np.int64)]
        at = np.flatnonzero((node >= 0) & (_mixed(block.u[i: i + WALK], round_) < share))
        p = sigmoid((block.margin[i: i + WALK] + column_margins(newer, bins))[at])
        codes.add(own, [code[at] for code in codes.of(bins)], node[at] if len(wanted) > 1 else None,
                  (p - block.label[i: i + WALK][at], np.maximum(p * (1 - p), 1e-16)))


def summed(parts: RDD, add: Callable):
    """One small result of every task, added up."""
    return reduce(add, parts.collect()) if parts.getNumPartitions() <= FEW_TASKS else parts.treeReduce(add)


def _with_margins(blocks: RDD, trees: dict[str, list[Tree]]) -> RDD:
    """The blocks with the margins of ``trees`` added."""
    sent = blocks.context.broadcast(trees)  # later passes carry the blocks' history: it names the trees only

    def add(block: _Block) -> _Block:
        return _Block(block.model, block.bins, block.label, block.u, block.margin + column_margins(sent.value[block.model], block.bins))

    return blocks.map(add).persist(StorageLevel.MEMORY_AND_DISK)


def best_split(sums: np.ndarray, starts: np.ndarray, columns: np.ndarray, settings: Settings) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, feature, cut, sums left of it) of the best cut of a node; None where no cut gains anything."""
    total = sums[:, starts[columns[0]]: starts[columns[0] + 1]].sum(1)
    upto = np.cumsum(sums, 1)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    before = np.concatenate([np.zeros((2, 1)), upto], 1)[:, starts[:-1]]  # sums of the features in front
    left = upto - before[:, owner]
    right = total[:, None] - left
    penalty = settings.l2
    gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - total[0] ** 2 / (total[1] + penalty)
    allowed = np.isin(owner, columns) & (left[1] >= settings.least_weight) & (right[1] >= settings.least_weight)
    allowed[starts[1:] - 1] = False  # nothing is right of the last bin
    gain = np.where(allowed, gain / 2, -np.inf)
    # sums come in any order: gains that differ by rounding alone are equal
    at = int(np.flatnonzero(gain >= gain.max() - 1e-9 * max(1.0, abs(gain.max())))[0]) if allowed.any() else 0
    if not allowed.any() or gain[at] <= 1e-6:
        return None
    return float(gain[at]), int(owner[at]), int(at - starts[owner[at]] + 1), left[:, at]


def fit_boosted(rows: DataFrame, key: str, settings: Settings = Settings()) -> tuple[dict[str, Model], DataFrame]:
    """Models by name and (model, key, label, train, margin, score) of all rows.

    ``rows`` holds ``model`` (text), ``key``, ``label`` (0/1), ``train`` (boolean) and ``features``
    (array of doubles, as long for all rows of a model). A model without training rows is left out,
    with its rows; an empty table gives no model.
    """
    if settings.bins > 256:
        raise ValueError("a bin is one byte")
    models = find_cuts(rows, settings)
    if not models:
        return {}, rows.select("model", key, F.col("label").cast("double").alias("label"), "train").withColumns(
            {"margin": F.lit(0.0), "score": F.lit(0.0)}).limit(0)
    binned = _binned(rows.where(F.col("model").isin(list(models))), models, key, settings)
    place = {name: i for i, name in enumerate(sorted(models))}
    sizes = {r["model"]: r["count"] for r in binned.where("train").groupBy("model").count().collect()}  # one row a model
    few = {name: model for name, model in models.items() if sizes[name] <= ALONE and sizes[name] * len(model.cuts) <= ALONE_BYTES}
    if few:
        _grow_alone(binned.where("train"), few, place, settings)
    many = {name: model for name, model in models.items() if name not in few}
    if many:
        _grow_together(binned.where(F.col("model").isin(list(many))), many, place, settings)
    return models, score_binned(binned, models, key)


def _used(model: Model, place: int, round_: int, settings: Settings) -> np.ndarray:
    """The columns that a tree may split on; ``place`` numbers the models."""
    draw = np.random.default_rng([settings.seed, round_, place])
    return np.sort(draw.choice(len(model.cuts), max(1, int(settings.columns * len(model.cuts))), replace=False))


def _grow_alone(train: DataFrame, models: dict[str, Model], place: dict[str, int], settings: Settings) -> None:
    """All trees of models with few rows, each model in one task."""
    numbered = {name: i for i, name in enumerate(sorted(models))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for name in set(names):
                mine = names == name
                bins = _matrix(batch.column(3).filter(pa.array(mine)), width)[:, : len(models[name].cuts)]
                held.setdefault(name, []).append((bins, batch.column(1).to_numpy()[mine], batch.column(2).to_numpy()[mine]))
        for name, parts in sorted(held.items()):
            model, first = models[name], models[name].starts()
            label, u = (np.concatenate(x) for x in list(zip(*parts))[1:])
            bins = np.concatenate([own.T for own, _, _ in parts], 1)
            codes, margin = Codes(first, np.arange(len(model.cuts))), np.full(len(label), model.base)
            coded = codes.of(bins)
            for round_ in range(settings.rounds):
                tree, columns = Tree.empty(settings.depth), _used(model, place[name], round_, settings)
                p = sigmoid(margin)
                weights = p - label, np.maximum(p * (1 - p), 1e-16)

                def sums_of(at: np.ndarray) -> np.ndarray:
                    own = np.zeros((1, 2, codes.total))
                    for i in range(0, len(at), WALK):
                        some = at[i: i + WALK]
                        codes.add(own, [code[some] for code in coded], None, tuple(w[some] for w in weights))
                    return codes.bins(own[0])

                drawn = np.flatnonzero(_mixed(u, round_) < settings.rows)
                open_ = {0: (drawn, sums_of(drawn))} if len(drawn) else {}
                for level in range(settings.depth):
                    below = {}
                    for node, (at, sums) in sorted(open_.items()):
                        if _split(tree, node, sums, first, columns, settings) and level + 1 < settings.depth:
                            right = bins[tree.feature[node]][at] >= tree.cut[node]
                            parts_ = [(2 * node + 1, at[~right]), (2 * node + 2, at[right])]
                            (light, few), (other, rest) = sorted(parts_, key=lambda x: len(x[1]))
                            own = sums_of(few)
                            below |= {light: (few, own), other: (rest, sums - own)}
                    open_ = below
                margin = margin + column_margins([tree], bins)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, round_, tree.feature, tree.cut, tree.value)],
                                                 names=["model", "round", "feature", "cut", "value"])

    width = max(len(m.cuts) for m in models.values())
    number = F.create_map(*[F.lit(x) for pair in numbered.items() for x in pair])[F.col("model")]
    dealt = train.where(F.col("model").isin(list(models))).select("model", "label", "u", "bins").repartitionById(len(models), number)
    grown = dealt.mapInArrow(run, "model string, round bigint, feature array<int>, cut array<int>, value array<double>").collect()  # trees only
    for r in sorted(grown, key=lambda r: (r["model"], r["round"])):
        models[r["model"]].trees.append(Tree(np.array(r["feature"], np.int32), np.array(r["cut"], np.int32), np.array(r["value"])))


def _grow_together(binned: DataFrame, models: dict[str, Model], place: dict[str, int], settings: Settings) -> None:
    """All trees of the models, in passes over the blocks of all tasks."""
    starts = {name: model.starts() for name, model in models.items()}
    first = state = _blocks(binned, models)
    done, held = 0, []
    for round_ in range(settings.rounds):
        used = {name: _used(model, place[name], round_, settings) for name, model in models.items()}
        newer = {name: model.trees[done:] for name, model in models.items()}
        for name, tree in _grow(state, starts, newer, used, round_, settings).items():
            models[name].trees.append(tree)
        if (round_ + 1) % FLUSH == 0 and round_ + 1 < settings.rounds:
            source, since = (first, 0) if (round_ + 1) % (FLUSH * RENEW) == 0 else (state, done)
            state, done = _with_margins(source, {name: model.trees[since:] for name, model in models.items()}), round_ + 1
            held.append(state)
            if len(held) > 2:  # the one before the last is made by now, and only the last is still to be read
                held.pop(0).unpersist()
    for kept in (first, *held):
        kept.unpersist()


def _grow(blocks: RDD, starts: dict[str, np.ndarray], newer: dict[str, list[Tree]], used: dict[str, np.ndarray], round_: int,
          settings: Settings) -> dict[str, Tree]:
    """The next tree of every model, level by level."""
    trees = {name: Tree.empty(settings.depth) for name in starts}
    wanted: dict[str, list[int]] = {name: [0] for name in starts}
    above: dict[tuple[str, int], np.ndarray] = {}
    for level in range(settings.depth):
        found = _level_sums(blocks, starts, newer, trees, used, level, round_, settings.rows, wanted)
        for (name, node), whole in above.items():  # by node split above
            light = next(child for child in (2 * node + 1, 2 * node + 2) if child in wanted[name])
            if (name, light) in found:
                whole = whole - found[name, light]
            found[name, 4 * node + 3 - light] = whole
        above, wanted = {}, {name: [] for name in starts}
        for (name, node), sums in sorted(found.items()):
            if _split(trees[name], node, sums, starts[name], used[name], settings):
                above[name, node] = sums
                f = trees[name].feature[node]
                weight = sums[1, starts[name][f]: starts[name][f + 1]]
                wanted[name].append(2 * node + 1 + int(2 * weight[: trees[name].cut[node]].sum() > weight.sum()))
        if not above:
            break
    return trees


def _split(tree: Tree, node: int, sums: np.ndarray, starts: np.ndarray, columns: np.ndarray, settings: Settings) -> bool:
    """Split a node of the tree by its sums, if a cut gains anything."""
    whole = sums[:, starts[columns[0]]: starts[columns[0] + 1]].sum(1)
    if node == 0:
        tree.value[0] = _leaf(whole, settings)
    best = best_split(sums, starts, columns, settings)
    if best:
        _, tree.feature[node], tree.cut[node], left = best
        tree.value[2 * node + 1], tree.value[2 * node + 2] = _leaf(left, settings), _leaf(whole - left, settings)
    return best is not None


def _leaf(sums: np.ndarray, settings: Settings) -> float:
    return float(-settings.rate * sums[0] / (sums[1] + settings.l2))


def score_binned(binned: DataFrame, models: dict[str, Model], key: str) -> DataFrame:
    """(model, key, label, train, margin, score) of binned rows."""
    width = max(len(m.cuts) for m in models.values())
    kind = binned.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            bins, margin = _matrix(batch.column(4), width), np.zeros(batch.num_rows)
            for name in set(names):
                mine = names == name
                margin[mine] = models[name].base + margins(models[name].trees, bins[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin), pa.array(sigmoid(margin))],
                                             names=["model", key, "label", "train", "margin", "score"])

    return binned.select("model", key, "label", "train", "bins").mapInArrow(
        run, f"model string, `{key}` {kind}, label double, train boolean, margin double, score double")


def node_table(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """(model, tree, node, feature, threshold, low, high, value): a row goes to ``high`` where its value is at least the threshold."""
    rows = []
    for name, model in models.items():
        for t, tree in enumerate(model.trees):
            for i in _reached(tree):
                f = int(tree.feature[i])
                leaf = f < 0
                rows.append((name, t, i, None if leaf else f, None if leaf else float(model.cuts[f][tree.cut[i] - 1]),
                             None if leaf else 2 * i + 1, None if leaf else 2 * i + 2, float(tree.value[i]) if leaf else None))
    return spark.createDataFrame(rows, "model string, tree int, node int, feature int, threshold double, low int, high int, value double")


def _reached(tree: Tree) -> list[int]:
    out, todo = [], [0]
    while todo:
        i = todo.pop()
        out.append(i)
        if tree.feature[i] >= 0:
            todo += [2 * i + 2, 2 * i + 1]
    return out
