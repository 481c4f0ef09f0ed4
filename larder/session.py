"""Session settings shared by jobs, tests and the bench, and the lineage-cut helper."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "larder") -> SparkSession:
    """Session for tests and the bench on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        # Java does not JIT-compile methods above 8000 bytes: let such stages use split projections.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="larder-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of an executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows written to the shared folder as columns, bucketed by ``keys``: what groups or joins by them is not exchanged again.

    A checkpoint holds rows as they lie in memory, some ten times as much.  The files stay as a checkpoint's do; ``discard``
    removes them.  Shuffle files of what led here go as soon as the driver has collected its garbage, hence now.
    """
    spark = df.sparkSession
    name, buckets = f"stored_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"{shared_folder(spark)}/{name}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", at).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    rows._larder_stored = at
    spark.sparkContext._jvm.System.gc()
    return rows


def discard(rows: DataFrame) -> None:
    """Remove the files of ``stored`` rows that no later query reads."""
    at = getattr(rows, "_larder_stored", None)
    if at is not None:
        context = rows.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def exchanged(df: DataFrame) -> DataFrame:
    """Side of a join that grows with the catalogue: both sides are exchanged.

    Before anything has run, Spark plans broadcasts from file sizes and default widths, far below what computed texts and
    lists hold, and the driver would have to collect the whole side.
    """
    return df.hint("merge")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session; their Python workers need not find it on their own path."""
    context = spark.sparkContext
    if getattr(context, "_larder_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="larder-")), "larder.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._larder_shipped = True
