"""Session helpers: one place for the settings that the operators assume."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Whether the shuffle files of a query go when it ends, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(master: str = "local[*]", app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsent(df: DataFrame) -> DataFrame:
    """The frame as a side of a join that is not broadcast: Spark takes rows that come out of compressed files, or of arrays, for far fewer bytes than they are."""
    return df.hint("merge")


def folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; that is set here only where it is unset, on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-tables-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """Write a table to a new folder.

    On a local file system Hadoop, without its native library, starts a process for each folder and file that it makes, and a
    process just started counts with all the memory of the one that starts it. So the folders are made here, and no mark of success.
    """
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    local = path.startswith("file:") or path.startswith("/") and conf.get("fs.defaultFS", "file:///").startswith("file:")
    if local:
        os.makedirs(here := "/" + path.removeprefix("file:").lstrip("/"))
        os.makedirs(f"{here}/_temporary/0/_temporary")
    df.write.mode("append" if local else "error").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)


def written(df: DataFrame) -> DataFrame:
    """The frame as a table that was written and is read again: what uses it more than once computes it once. The shuffle files it took are freed at once."""
    path, conf = folder(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        write(df, path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)
