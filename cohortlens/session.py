"""Session settings and the few physical decisions the operators share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "cohortlens", **conf: str) -> SparkSession:
    """Session with the settings the operators assume; keyword names use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, which may not have it installed; once a session."""
    context = spark.sparkContext
    if getattr(context, "_cohortlens_sent", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("cohortlens", os.path.relpath(path, here)))
    folder = tempfile.mkdtemp(prefix="cohortlens-")  # the driver serves the file from here
    path = os.path.join(folder, "cohortlens.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    context._cohortlens_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local master that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/cohortlens-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, partition_by: list[str] | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` once as parquet below the shared folder and read it back.

    Used where an intermediate feeds several passes: it cuts the lineage, survives lost executors,
    and later passes read only their columns and know the size. The copy is deleted when the
    driver ends; ``discard`` does so earlier. ``free`` deletes the shuffle files of the write at its
    end, which else stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true" if free else before)
    try:
        df.write.parquet(path, partitionBy=partition_by)
    finally:
        spark.conf.set(_FREE, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._cohortlens_path = path
    return written


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores (by ``keys`` where given), for costly Python steps over small bytes.

    Adaptive execution merges small partitions by their bytes, which says nothing of the work; it leaves
    a stated number alone.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads files, with columns and filters on top: computing it again costs no more than a copy would."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def discard(df: DataFrame) -> None:
    """Delete the copy that ``materialize`` returned, once nothing reads it any more."""
    path = getattr(df, "_cohortlens_path", None)
    if path:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
