"""Session settings for local runs and tests; a cluster brings its own."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "chalkline") -> SparkSession:
    cpus = cpus or os.cpu_count() or 2
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Parquet grows when decoded; without this Spark broadcasts files that only look small.
        .config("spark.sql.sources.fileCompressionFactor", "4.0")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def first_partitions(spark: SparkSession) -> int:
    """How many partitions the session's shuffles start with, before adaptive execution joins small ones."""
    own = spark.conf.get("spark.sql.shuffle.partitions")
    return max(int(own), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or own))


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only for a local master, where all tasks share its disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="chalkline-")
    return _own_folders[app]
