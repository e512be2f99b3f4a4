"""Session defaults, the shared scratch folder and size checks for small tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A table may be broadcast or read to the driver only below this many rows.
SMALL_ROWS = 200_000


def local_session(cores: str = "8", partitions: int = 8, app: str = "emberlog") -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Local data is small but the work per row is not: keep the cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or a new one in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        # Only plain local mode runs its tasks on the driver's machine, under its own file system.
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="emberlog-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), "emberlog", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path of this application below the shared folder."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several later steps read to a table in the shared folder.

    Cuts lineage without depending on the executors that wrote it, and unlike an RDD
    checkpoint runs the plan once and keeps columns prunable.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application staged; call when no returned frame is in use any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list:
    """Rows of a table that must be small; raises instead of pulling a large one."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows on the driver")
    return rows
