"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docketry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docketry-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one set on the context.

    On one machine (a ``local`` master) any folder is shared, so a private one
    is made where none is named. A cluster without the setting is an error:
    no machine's own folder can stand in for it.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="docketry-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written copy.

    Used before a result is scanned several times (iterations, rank searches),
    so that the passes neither repeat the joins above nor depend on executors.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a small frame in memory while several jobs read it; leaves the caller's own storage alone."""
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written under the shared folder and read back.

    Files tell the planner their bytes, so a small table is broadcast by Spark's
    own threshold and a large one is not; no row count is needed.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for written tables."""
    import uuid

    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the functions that run in Python workers."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="docketry-ship-"), "docketry.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("docketry", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
