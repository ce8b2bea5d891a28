"""Helpers the operators of this subpackage share: reading tables, Arrow maps, fresh names, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortlens.session import materialize

#: ASCII capitals to small letters, as a table for ``bytes.translate``.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_place(docs: DataFrame, source: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """``docs`` with the text, and its place: its own column, or a copy where ``docs`` has dropped that name."""
    if text_col in docs.columns:
        return docs, docs.columns.index(text_col)
    copy = fresh(source, "_text")
    return source.withColumn(copy, F.col(text_col)).select(*docs.columns, copy), len(docs.columns)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], extra: dict[str, str],
              keep: list[str] | None = None) -> DataFrame:
    """Append the columns ``fn`` returns for each Arrow batch (name -> array or list) to ``keep``."""
    keep = df.columns if keep is None else keep
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in extra.items()])
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    arrow = pa_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch)
            arrays = [batch.column(c) for c in keep] + [
                new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[f.name for f in arrow]])

    return df.mapInArrow(run, schema)


def pa_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def table_of(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A small driver-side table from name -> (type, values)."""
    schema = ", ".join(f"`{n}` {t}" for n, (t, _) in columns.items())
    rows = list(zip(*[v for _, v in columns.values()]))
    return spark.createDataFrame(rows, schema)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph with edges ``a``-``b``; roots are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    parent = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        x, y = parent[x], parent[y]
        rest = x != y
        x, y = x[rest], y[rest]
    inner = parent != np.arange(len(nodes))
    return nodes[inner], nodes[parent[inner]]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an undirected graph of bigints; the root is the component's smallest node.

    Each round takes every node's smallest neighbour as its parent (combined map-side), climbs to
    the top of these chains by pointer jumping, and contracts the edges to the tops that remain.
    Every round is a written table, so nothing depends on one executor; a node with very many
    edges is only ever the unique side of a join against rows that adaptive execution can split.
    """
    spark = edges.sparkSession
    left = materialize(edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
                       .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = None
    while not left.isEmpty():
        parent = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        lows = left.select(F.col("a").alias("node")).distinct().withColumn("up", F.col("node"))
        parent = materialize(parent.union(lows).groupBy("node").agg(F.min("up").alias("up")))
        while True:  # halve the chains until every node points to a top
            top = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialize(parent.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("node", "up")
            if not moved:
                break
        if names is None:
            names = parent.select("node", F.col("up").alias("root"))
        else:
            above = parent.select(F.col("node").alias("root"), F.col("up").alias("above"))
            names = materialize(names.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        pa_, pb = (parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        left = materialize(left.join(pa_, "a").join(pb, "b").where("a_up <> b_up")
                           .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
    if names is None:
        return spark.createDataFrame([], "node bigint, root bigint")
    return names
