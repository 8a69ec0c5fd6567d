"""What the corpus operators share: scratch tables in the shared folder, row identity, batches.

Scratch tables are Parquet below ``spark.checkpoint.dir``: every executor can read them, and a
lost executor costs no more than the running tasks. They go when the owning process ends or
when :func:`release` is called (the corpus pipeline does so between stages).
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera import session

#: Bytes of text that a kernel works on at once.
CHUNK_BYTES = 8 << 20
#: While a scratch table is written: shuffle files go with the job, and Arrow batches are small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Folders made so far. Names only: functions that run on executors carry this module's values.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where unset, on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:  # the session has been stopped: what is on this machine can still go
        if path.startswith(("file:/", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def made() -> list[str]:
    """The folders of scratch tables that exist now."""
    return list(_made)


def release(paths: list[str] | None = None) -> None:
    """Delete scratch tables (all of them, unless given). Frames that read them end with it."""
    for path in made() if paths is None else paths:
        if path in _made:
            _made.remove(path)
            _delete(path)


atexit.register(release)


class Scratch:
    """A folder of scratch tables for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        _made.append(self.path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return it as read back; the shuffle files it took are freed at once."""
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in _WRITING}
        with contextlib.suppress(Exception):
            for k, v in _WRITING.items():
                conf.set(k, v)
        try:
            session.write(df, f"{self.path}/{name}")
        finally:
            with contextlib.suppress(Exception):
                for k, v in before.items():
                    conf.set(k, v) if v is not None else conf.unset(k)
        return self.get(df, name)

    def get(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        _delete(f"{self.path}/{name}")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(name: str) -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def column(name: str) -> Column:
    """A top-level column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, as Spark compares names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, more: str) -> T.StructType:
    """The frame's schema, whatever its names are, and more fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the held-out quarter: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text in each, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def small(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], column: str = "text", limit: int = 2 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over slices with little text each, so that what a worker holds has a bound."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(part for batch in batches for part in chunks(batch, column, limit))

    return sliced
