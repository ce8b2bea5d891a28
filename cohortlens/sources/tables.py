"""Sources, sinks and layered tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_text_csv(spark: SparkSession, path: str, numeric: list[str] | None = None) -> DataFrame:
    """CSV with header, every column text; ``numeric`` columns become double, bad values null."""
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=False)
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in numeric or []})


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header and a given schema, or inferred types (one extra pass) without one."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def with_lineage(df: DataFrame, source: str) -> DataFrame:
    """Add ingestion time and source label."""
    return df.select("*", F.current_timestamp().alias("ingested_at"), F.lit(source).alias("_source"))


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> DataFrame:
    absent = sorted(set(required) - set(df.columns))
    if absent:
        raise ValueError(f"missing columns in {what}: {absent}")
    return df


def read_parquet(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    return require_columns(spark.read.parquet(path), required or [], path)


def write_rows(df: DataFrame, path: str) -> None:
    """Row-level results (predictions, assignments, contributions) as parquet."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A result table of a few rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_metadata(df: DataFrame, path: str) -> None:
    """Run metadata (one row, nested structs allowed) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def metadata_row(df: DataFrame, **fields: object) -> DataFrame:
    """Append literal fields to a one-row DataFrame; dicts become structs."""
    def lit(v: object):
        if isinstance(v, dict):
            return F.struct(*[lit(x).alias(k) for k, x in v.items()])
        return F.lit(v)
    return df.select("*", *[lit(v).alias(k) for k, v in fields.items()])


def build_layers(
    spark: SparkSession,
    layers: dict[str, dict[str, Callable[[], DataFrame]]],
    root: str | None = None,
) -> DataFrame:
    """Run ordered layers of table builders and replace each table; returns the listing.

    With ``root`` each table is a parquet folder ``root/layer/table``; otherwise it is a
    catalog table in the database of that layer.
    """
    built = []
    for layer, tables in layers.items():
        if root is None:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
        for name, make in tables.items():
            writer = make().write.mode("overwrite")
            if root is None:
                writer.saveAsTable(f"{layer}.{name}")
            else:
                writer.parquet(f"{root.rstrip('/')}/{layer}/{name}")
            built.append((layer, name))
    return spark.createDataFrame(built, "layer string, name string")


def list_tables(spark: SparkSession, layers: list[str]) -> DataFrame:
    rows = [(t.namespace[0], t.name) for db in layers for t in spark.catalog.listTables(db)]
    return spark.createDataFrame(rows, "layer string, name string")


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and an order-free content sum of a table, one row.

    A row counts the first 32 bits of the MD5 of its columns' text forms, joined by the unit separator;
    a null is the record separator.
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in columns or df.columns]
    first_bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(first_bits).alias("content_sum"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file below ``path`` (for raw files that fit one task each)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
