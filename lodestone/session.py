"""Session helpers: tables, and the folder that driver and executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each context, wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_lodestone_shipped", False):
        context._lodestone_shipped = True
        root = Path(__file__).resolve().parent
        if root.is_dir():  # a package that was itself shipped as a zip is already there
            context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, on any file system Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    The cluster names that folder. Only where the setting is missing and Spark runs in
    one process (tests, notebooks) is a temporary folder used and remembered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_lodestone_dir", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="lodestone-")
            spark.sparkContext._lodestone_dir = base
    path = f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """Folders that this context has been given by shared_dir(), oldest first."""
    context = spark.sparkContext
    if not hasattr(context, "_lodestone_made"):
        context._lodestone_made = []
    return context._lodestone_made


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of shared_dir(), whatever file system they are on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in made(spark):
            made(spark).remove(path)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    ship(df.sparkSession)
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_estimate(df: DataFrame) -> int:
    """Bytes by the optimizer's statistics; what it cannot tell counts as nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 53 else 0
