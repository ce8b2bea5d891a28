"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Cosine c between unit vectors is distance sqrt(2 - 2c), so the threshold is a distance t. Vectors are
dealt into cells around anchors, cells are split by a hash to a bounded size, and every sub-cell gets
a cover tree: a farthest-first order gives nested levels with radii 2, 1, 1/2, ..., each level a prefix
of the order whose points lie further apart than the radius and cover all others within it. Two trees are
compared from the roots down. With covering radii p and q of two nodes at distance d, no pair below
them links if d - p - q > t, and all do if d + p + q <= t; only other node pairs are opened. Whole
groups of copies are so counted and joined without spelling out their pairs. The same bound between
cells decides which of them meet at all.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import components, local_forest, table_of
from cohortlens.llm.feistel import number_rows
from cohortlens.session import materialize

#: Vectors of one tree. A pair task holds two trees.
TREE_ROWS = 4_096
#: Sample that places the anchors, and anchors per vector length.
SAMPLE, ANCHORS = 4_096, 16
#: Node pairs with at most so many vector pairs are compared vector by vector.
LEAF_PAIRS = 1 << 14
#: Those with at most so many are gathered and compared together.
SMALL_PAIRS = 128
_SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for very large and small values."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def farthest_first(u: np.ndarray, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (each next one farthest from those before) and their distance when taken."""
    n = len(u)
    stop = n if stop is None else min(stop, n)
    order, reach = np.zeros(stop, np.int64), np.full(stop, 2.0)
    near = np.full(n, np.inf)
    at = 0
    for i in range(stop):
        order[i] = at
        if i:
            reach[i] = math.sqrt(max(near[at], 0.0))
        d2 = np.maximum(2.0 - 2.0 * (u @ u[at]), 0.0)
        near = np.minimum(near, d2)
        near[at] = -1.0
        at = int(np.argmax(near))
    return order, reach


class CoverTree:
    """Nested levels over unit vectors. Vectors lie in depth-first order, so a node is a slice.

    Per level: ``point`` (the node's own vector), ``first``/``last`` (its slice), ``radius`` (largest
    distance to a vector below it), ``children`` (range of its nodes on the next level).
    """

    def __init__(self, u: np.ndarray, weights: np.ndarray) -> None:
        n = len(u)
        order, reach = farthest_first(u)
        # sizes of the nets with radius 2, 1, 1/2, ... down to where all vectors are apart
        sizes, r = [1], 1.0
        while sizes[-1] < n and r > 1e-7:
            sizes.append(max(sizes[-1], int(np.searchsorted(-reach[1:], -r, side="left")) + 1))
            r /= 2
        if sizes[-1] < n:
            sizes.append(n)
        v = u[order]
        up = []  # parent on the level above, for the points that a level adds
        for a, b in zip(sizes, sizes[1:]):
            near = [np.argmax(v[i: min(i + 512, b)] @ v[:a].T, 1) for i in range(a, b, 512)]
            up.append(np.concatenate([np.arange(a), *near]).astype(np.int64))
        # ancestors of every point on every level
        above = [np.arange(n)]
        for parents in reversed(up):
            above.append(parents[above[-1]])
        above = above[::-1]
        dfs = np.lexsort(above[::-1])
        self.u, self.weights, self.rows = v[dfs], weights[order][dfs], order[dfs]
        place = np.empty(n, np.int64)
        place[dfs] = np.arange(n)
        self.levels = []
        for own in above:
            label = own[dfs]
            first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            last = np.append(first[1:], n)
            point = place[label[first]]
            d2 = 2.0 - 2.0 * np.einsum("ij,ij->i", self.u, self.u[np.repeat(point, last - first)])
            radius = np.sqrt(np.maximum(np.maximum.reduceat(d2, first), 0.0))
            radius[last - first == 1] = 0.0
            self.levels.append({"point": point, "first": first, "last": last, "radius": radius})
        for level, below in zip(self.levels, self.levels[1:]):
            level["child"] = np.searchsorted(below["first"], np.append(level["first"], n))
        self._sum()

    def _sum(self) -> None:
        self.total = np.concatenate([[0], np.cumsum(self.weights)])

    def pack(self, keys: list[bytes]) -> bytes:
        """The tree with its vectors' own bytes (in the order they came) in place of unit vectors."""
        levels = [{k: v.astype(np.float64 if k == "radius" else np.int32) for k, v in level.items()} for level in self.levels]
        return pickle.dumps((b"".join([keys[i] for i in self.rows]), self.weights, levels))

    @classmethod
    def unpack(cls, packed: bytes, kind: str, dim: int) -> "CoverTree":
        tree = cls.__new__(cls)
        keys, tree.weights, tree.levels = pickle.loads(packed)
        tree.u = unit(np.frombuffer(keys, kind).reshape(-1, dim))
        tree._sum()
        return tree


class _Links:
    """What a traversal finds: links per vector (as differences over slices) and joining edges."""

    def __init__(self, na: int, nb: int) -> None:
        self.a, self.b = np.zeros(na + 1, np.int64), np.zeros(nb + 1, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        self.held += len(a)
        if self.held > 1 << 20:
            self.edges = [self.forest()]
            self.held = len(self.edges[0][0])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return local_forest(np.concatenate([x for x, _ in self.edges]), np.concatenate([y for _, y in self.edges]))


def dual_traversal(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links per vector of ``a`` and of ``b`` and joining edges (places in ``a``; in ``b`` plus len(a)).

    With ``a is b`` each pair counts once for both ends, and a vector is no link of its own.
    """
    t = math.sqrt(2.0 - 2.0 * cosine)
    same = a is b
    shift = 0 if same else len(a.u)
    out = _Links(len(a.u), len(b.u))
    single_a, single_b = a.u.astype(np.float32), b.u.astype(np.float32)

    def add(side: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> None:
        np.add.at(side, first, n)
        np.add.at(side, last, -n)

    def whole(fa: int, la: int, fb: int, lb: int) -> None:
        """All pairs of two slices link."""
        out.a[fa] += b.total[lb] - b.total[fb]
        out.a[la] -= b.total[lb] - b.total[fb]
        if same and fa == fb:
            out.b[fa] += 1  # each vector met itself here
            out.b[la] -= 1
        else:
            side = out.a if same else out.b
            side[fb] += a.total[la] - a.total[fa]
            side[lb] -= a.total[la] - a.total[fa]
        nodes = np.concatenate([np.arange(fa, la), np.arange(fb, lb) + shift])
        out.join(np.full(len(nodes), fa), nodes)

    def pairs(ia: np.ndarray, ib: np.ndarray) -> None:
        """Single vectors against each other, by the exact cosine."""
        near = np.einsum("ij,ij->i", a.u[ia], b.u[ib]) >= cosine
        ia, ib = ia[near], ib[near]
        if len(ia):
            add(out.a, ia, ia + 1, b.weights[ib])
            add(out.a if same else out.b, ib, ib + 1, a.weights[ia])
            out.join(ia, ib + shift)

    def block(fa: int, la: int, fb: int, lb: int) -> None:
        near = a.u[fa:la] @ b.u[fb:lb].T >= cosine
        if same and fa == fb:
            near = np.triu(near, 1)
        ia, ib = np.nonzero(near)
        if len(ia):
            pairs(ia + fa, ib + fb)

    def small(fa: np.ndarray, la: np.ndarray, fb: np.ndarray, lb: np.ndarray) -> None:
        """Many small node pairs at once, vector by vector."""
        n = (la - fa) * (lb - fb)
        ends = np.cumsum(n)
        for s in range(0, len(n), 512):
            k = slice(s, s + 512)
            which = np.repeat(np.arange(len(n[k])), n[k])
            at = np.arange(len(which)) - np.repeat(ends[k] - n[k] - (ends[s] - n[s]), n[k])
            wide = (lb - fb)[k][which]
            pairs(fa[k][which] + at // wide, fb[k][which] + at % wide)

    depth = max(len(a.levels), len(b.levels))
    at = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
    frontier = (np.zeros(1, np.int64), np.zeros(1, np.int64))
    for k in range(depth):
        la_, lb_ = at(a, k), at(b, k)
        na_, nb_ = at(a, k + 1), at(b, k + 1)
        end_a, end_b = k + 1 >= len(a.levels), k + 1 >= len(b.levels)
        opened: list[tuple[np.ndarray, np.ndarray]] = []
        i, j = frontier
        slices = np.stack([la_["first"][i], la_["last"][i], lb_["first"][j], lb_["last"][j]]).astype(np.int64)
        size = (slices[1] - slices[0]) * (slices[3] - slices[2])
        few = (size <= SMALL_PAIRS) & ~(same & (i == j))
        small(*slices[:, few])
        for i, j, fa, la, fb, lb in zip(i[~few].tolist(), j[~few].tolist(), *slices[:, ~few].tolist()):
            own = same and i == j
            if (la - fa) * (lb - fb) <= LEAF_PAIRS or k + 1 == depth:
                block(fa, la, fb, lb)
                continue
            ca = np.array([i]) if end_a else np.arange(la_["child"][i], la_["child"][i + 1])
            cb = np.array([j]) if end_b else np.arange(lb_["child"][j], lb_["child"][j + 1])
            ra, rb = na_["radius"][ca], nb_["radius"][cb]
            pa_, pb_ = na_["point"][ca], nb_["point"][cb]
            # nodes with equal radii together: one bound prunes their whole block of the product
            for ga in _by_radius(ra):
                for gb in _by_radius(rb):
                    bound = t + ra[ga].max() + rb[gb].max()
                    floor = np.float32(1.0 - bound * bound / 2.0 - 1e-5) if bound < 2 else np.float32(-2)
                    for s in range(0, len(ga), 1024):
                        rows = ga[s: s + 1024]
                        x, y = np.nonzero(single_a[pa_[rows]] @ single_b[pb_[gb]].T >= floor)
                        x, y = rows[x], gb[y]
                        if own:
                            x, y = x[x <= y], y[x <= y]
                        if not len(x):
                            continue
                        d = np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("ij,ij->i", a.u[pa_[x]], b.u[pb_[y]]), 0.0))
                        d[(pa_[x] == pb_[y]) & same] = 0.0
                        reach = ra[x] + rb[y]
                        live = d <= reach + t + _SLACK
                        x, y, d, reach = x[live], y[live], d[live], reach[live]
                        one = (na_["last"][ca[x]] - na_["first"][ca[x]] == 1) & (nb_["last"][cb[y]] - nb_["first"][cb[y]] == 1)
                        selfs = (ca[x] == cb[y]) if own else np.zeros(len(x), bool)
                        pairs(pa_[x[one & ~selfs]], pb_[y[one & ~selfs]])
                        full = ~one & (d + reach <= t - _SLACK)
                        for p, q in zip(ca[x[full]].tolist(), cb[y[full]].tolist()):
                            whole(*(int(z) for z in (na_["first"][p], na_["last"][p], nb_["first"][q], nb_["last"][q])))
                        rest = ~one & ~full
                        opened.append((ca[x[rest]], cb[y[rest]]))
        frontier = tuple(np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*opened)) if opened else (np.zeros(0, np.int64),) * 2
    ea, eb = out.forest()
    links_a, links_b = np.cumsum(out.a)[:-1], np.cumsum(out.b)[:-1]
    if same:
        links_a, links_b = links_a - links_b * a.weights, np.zeros(len(a.u), np.int64)
    return links_a, links_b, ea, eb


def _by_radius(radius: np.ndarray) -> list[np.ndarray]:
    """Places grouped by the radius' power of two, zero apart."""
    key = np.where(radius > 0, np.ceil(np.log2(np.maximum(radius, 1e-12))), -99)
    return [np.flatnonzero(key == k) for k in np.unique(key)]


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, key) and distinct usable vectors (key, n, first_id); the key is the vector's bytes.

    The key is null for vectors that are null, empty, zero or hold null or non-finite components.
    """
    item = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = {"float": "<f4"}.get(item, "<f8")
    id_name = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), kind)
                keys.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["vec_id", "key"])

    rows = materialize(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, f"vec_id {id_name}, key binary"))
    distinct = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    return rows, distinct


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                 tree_rows: int = TREE_ROWS, sample: int = SAMPLE, anchors: int = ANCHORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Links join rows whose cosine is at least ``cosine``; equal vectors are handled as one with a
    weight. Vectors of different length, and unusable ones (see ``distinct_vectors``), link with nothing;
    a row without links is its own component. Repeated rows count each other. A null id gets the
    component of its group, null if it is alone. An empty table gives an empty result.
    ``sample`` vectors (smallest hashes) place the anchors; every vector is then assigned and compared.
    """
    kind = {"float": "<f4"}.get(vectors.schema[vector_col].dataType.elementType.simpleString(), "<f8")
    rows, distinct = distinct_vectors(vectors, id_col, vector_col)
    numbered, n = number_rows(distinct, ["key"], "node")
    numbered = materialize(numbered)

    # anchors per vector length, farthest first over the sample
    fitted: dict[int, list[np.ndarray]] = {}
    for r in numbered.orderBy(F.xxhash64("key"), "key").limit(sample).select("key").collect():
        x = np.frombuffer(bytes(r["key"]), kind)
        fitted.setdefault(len(x), []).append(x)
    centres = {}
    for d, xs in fitted.items():
        u = unit(np.stack(xs))
        centres[d] = u[farthest_first(u, anchors)[0]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            dims = np.array([len(k) // int(kind[-1]) for k in keys], np.int64)
            cell, far = np.zeros(len(keys), np.int64), np.zeros(len(keys))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if int(d) not in centres:  # a length the sample missed: one cell, any radius
                    far[at] = 2.0
                    continue
                u = unit(np.stack([np.frombuffer(keys[i], kind) for i in at]))
                dots = u @ centres[int(d)].T
                cell[at] = np.argmax(dots, 1)
                far[at] = np.sqrt(np.maximum(2.0 - 2.0 * dots[np.arange(len(at)), cell[at]], 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(cell), pa.array(far), *batch.columns],
                                             names=["dim", "cell", "far", "key", "node", "n"])

    placed = materialize(numbered.select("key", "node", "n").mapInArrow(
        assign, "dim bigint, cell bigint, far double, key binary, node bigint, n bigint"))
    facts = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("size"), F.max("far").alias("radius")).collect()
    # sub-cells are numbered on; cells that the covering bound lets meet are listed, own first
    t = math.sqrt(2.0 - 2.0 * cosine)
    cells = sorted((r["dim"], r["cell"], -(-r["size"] // tree_rows), r["radius"]) for r in facts)
    base, at = {}, 0
    for d, c, k, _ in cells:
        base[d, c] = (at, k)
        at += k
    meets = {}
    for d, c, _, radius in cells:
        meets[d, c] = [base[d, e] for d2, e, _, other in cells if d2 == d and (
            e == c or d not in centres or np.linalg.norm(centres[d][c] - centres[d][e]) <= radius + other + t + _SLACK)]
    spark = vectors.sparkSession
    table = table_of(spark, {"dim": ("bigint", [c[0] for c in cells]), "cell": ("bigint", [c[1] for c in cells]),
                             "first": ("bigint", [base[c[0], c[1]][0] for c in cells]), "parts": ("bigint", [c[2] for c in cells])})
    split = placed.join(F.broadcast(table), ["dim", "cell"]).select(
        "dim", "cell", (F.col("first") + F.pmod(F.xxhash64("node"), "parts")).alias("sub"), "key", "node", "n")

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for a sub-cell: its tree and the nodes in the tree's order."""
        pdf = pdf.sort_values("node")
        dim, keys = int(pdf["dim"].iloc[0]), pdf["key"].tolist()
        tree = CoverTree(unit(np.frombuffer(b"".join(keys), kind).reshape(-1, dim)), pdf["n"].to_numpy())
        return pd.DataFrame({"dim": [dim], "cell": [pdf["cell"].iloc[0]], "sub": [pdf["sub"].iloc[0]],
                             "packed": [pickle.dumps((tree.pack(keys), pdf["node"].to_numpy()[tree.rows]))]})

    trees = materialize(split.groupBy("sub").applyInPandas(plant, "dim bigint, cell bigint, sub bigint, packed binary"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, c, s, packed in zip(*(col.to_pylist() for col in batch.columns)):
                for first, parts in meets[d, c]:
                    for o in range(first, first + parts):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([min(s, o)]), pa.array([max(s, o)]), pa.array([s]), pa.array([d]), pa.array([packed], pa.binary())],
                            names=["low", "high", "sub", "dim", "packed"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        side = {}
        for s, d, packed in zip(pdf["sub"], pdf["dim"], pdf["packed"]):
            if s not in side:
                tree, nodes = pickle.loads(packed)
                side[s] = (CoverTree.unpack(tree, kind, d), nodes)
        (a, na), (b, nb) = side[low], side[high]
        la, lb, ea, eb = dual_traversal(a, b, cosine)
        nodes = na if a is b else np.concatenate([na, nb])
        links = la if a is b else np.concatenate([la, lb])
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": np.concatenate([nodes[at], nodes[ea]]),
                             "links": np.concatenate([links[at], np.zeros(len(ea), np.int64)]),
                             "other": np.concatenate([np.full(len(at), -1), nodes[eb]])})

    met = materialize(trees.mapInArrow(send, "low bigint, high bigint, sub bigint, dim bigint, packed binary")
                      .groupBy("low", "high").applyInPandas(meet, "node bigint, links bigint, other bigint"))
    counted = met.where("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.where("other >= 0"), "node", "other")
    labelled = numbered.join(counted, "node", "left").join(roots, "node", "left").select(
        "key", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    labelled = materialize(labelled)
    firsts = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = materialize(labelled.join(firsts, "root").select(F.col("key").alias("vector"), "n_links", "component_id"))
    out = rows.join(labels, rows.key == labels.vector, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
