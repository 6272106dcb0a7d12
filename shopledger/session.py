"""Session defaults for running the reports outside a managed cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | None = None, app: str = "shopledger") -> SparkSession:
    """A local session for tests and benchmarks.

    On a cluster the caller brings its own session; nothing in this package sets
    shuffle widths, broadcast limits or checkpoint folders on it.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    Only a local session without one gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="shopledger-")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it from there."""
    target = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.parquet(target)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go with each write, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def emptied(spark: SparkSession, folder: str) -> None:
    """Drop the files of a folder that Spark wrote and nothing reads any more; an empty one stays."""
    spark.range(0).selectExpr("CAST(id AS STRING) AS value").write.mode("overwrite").text(folder)
