"""The record view of the driver's tables: parts as records of three sources, and their true links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country, source."""
    source = (F.col("p_partkey") % 3 + 1).cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), source, F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.col("p_name").alias("business_name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), F.lower("p_type"), F.lit("st")).alias("business_address"),
        F.col("p_brand").alias("country"),
        F.concat(F.lit("S"), source).alias("source"),
    )


def queries(recs: DataFrame) -> DataFrame:
    return recs.where(F.col("source") == "S1").select(F.col("entity_id").alias("qid"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")


def pool(recs: DataFrame) -> DataFrame:
    return recs.where(F.col("source") != "S1").select(F.col("entity_id").alias("tid"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")


def truth(recs: DataFrame) -> DataFrame:
    """qid, tid: links of equal name and address kind within a country."""
    kind = F.element_at(F.split("address", " "), 2).alias("kind")
    q, t = queries(recs).withColumn("kind", kind), pool(recs).withColumn("kind", kind)
    return q.select("qid", "name", "kind", "country").join(t.select("tid", "name", "kind", "country"), ["name", "kind", "country"]).select("qid", "tid")


def pool_from(*sources: DataFrame, country: str | None = None) -> DataFrame:
    """A pool from several sources, one row an id, the first source's; optionally of one country."""
    from pyspark.sql import Window as W

    all_ = None
    for i, s in enumerate(sources):
        part = s.withColumn("_order", F.lit(i))
        all_ = part if all_ is None else all_.unionByName(part)
    if country is not None:
        all_ = all_.where(F.col("country") == country)
    first = F.row_number().over(W.partitionBy("entity_id").orderBy("_order", "business_name", "business_address"))
    return all_.withColumn("_first", first).where(F.col("_first") == 1).drop("_first", "_order")
