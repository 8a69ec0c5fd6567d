"""Scans: records, truth, id lists, manifests, bundles. All text stays text; nothing is taken for missing."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.operators.splits import exposed

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A tab-separated file with a header that must be the schema's names; empty fields are empty texts."""
    head = [r["value"] for r in spark.read.text(path).limit(1).collect()]
    if head and head[0].split("\t") != schema.fieldNames():
        raise ValueError(f"header {head[0]!r} is not {schema.fieldNames()}")
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path).na.fill("")


def id_list(x: Column) -> Column:
    """The items of a comma list, trimmed, blanks dropped; an empty list for an empty text."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def id_count(x: Column) -> Column:
    """How many items a comma list has by its commas: 0 if it is blank."""
    y = F.coalesce(x, F.lit(""))
    return F.when(F.trim(y) == "", 0).otherwise(F.length(y) - F.length(F.replace(y, F.lit(","), F.lit(""))) + 1)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """qid, ids (an array, empty for none)."""
    return tsv(spark, path, TRUTH).select(F.col("source1_entity_id").alias("qid"), id_list(F.col("matched_entity_ids")).alias("ids"))


def held_truth(spark: SparkSession, path: str) -> DataFrame:
    """The truth of the ids that the exposure hash selects."""
    return truth(spark, path).where(exposed(F.col("qid")))


def id_lists(spark: SparkSession, path: str, column: str) -> DataFrame:
    schema = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField(column, T.StringType())])
    return tsv(spark, path, schema).select(F.col("source1_entity_id").alias("qid"), id_list(F.col(column)).alias("ids"))


def pairs(lists: DataFrame) -> DataFrame:
    return lists.select("qid", F.explode("ids").alias("tid"))


def capped(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key: a cap needs an order."""
    return rows.orderBy(key).limit(n)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The query ids of a JSON manifest."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("query_ids").alias("qid"))


def bundle(spark: SparkSession, folder: str, parts: tuple[str, ...] = ("train", "eval"), whole: str = "bundle") -> DataFrame:
    """A bundle's parts if all are there, else the single table, else an error."""
    if all(exists(spark, f"{folder}/{p}.parquet") for p in parts):
        out = None
        for p in parts:
            own = spark.read.parquet(f"{folder}/{p}.parquet").withColumn("part", F.lit(p))
            out = own if out is None else out.unionByName(own)
        return out
    if exists(spark, f"{folder}/{whole}.parquet"):
        return spark.read.parquet(f"{folder}/{whole}.parquet").withColumn("part", F.lit(whole))
    raise FileNotFoundError(f"no bundle in {folder}")


def complete(spark: SparkSession, folder: str, names: tuple[str, ...]) -> list[str]:
    """The files that a data folder lacks."""
    return [n for n in names if not exists(spark, f"{folder}/{n}")]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def revision(folder: str) -> dict[str, str | bool]:
    """On the driver: the revision that a working folder is at, and whether it has changes."""
    say = lambda *words: subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, check=True).stdout.strip()
    return {"commit": say("rev-parse", "HEAD"), "branch": say("rev-parse", "--abbrev-ref", "HEAD"), "changed": bool(say("status", "--porcelain"))}
