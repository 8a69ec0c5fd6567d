"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Toxic documents go, exact copies go, one document of each near-duplicate group stays, documents that
hold benchmark items go, and what is left is mixed to the target weights. All stages but the last
return the columns of ``documents``; the last says how many words of each document the mix takes.

Rows equal in id and text are one document to the near-duplicate and benchmark stages. SQL cannot
express the stages (a trained classifier, Hamming links, a randomised SVD), so there is no oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import common, decontam, exact, mixing, simhash, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The stage that was called last by itself, and the scratch tables that it made.
_last: tuple[int, list[str]] = (-1, [])


def _watched(work: Stage, spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """A stage's result and the scratch tables that it reads from."""
    before = set(common.made())
    out = work(spark, docs, sf_dir)
    return out, [x for x in common.made() if x not in before]


def _stage(place: int, work: Stage) -> Stage:
    """A stage that is called by itself: the scratch tables of the stage before it go, as that one's result has been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        if _last[0] == place - 1:
            common.release(_last[1])
        out, made = _watched(work, spark, docs, sf_dir)
        _last = (place, made)
        return out

    return run


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.documents(spark, sf_dir, "labels").where(~common.held_out(F.col("doc_id")))
    return toxicity.reject(docs, toxicity.learn(docs, labels))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, common.documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


_WORK: list[tuple[str, Stage]] = [("toxicity", toxic), ("exact", copies), ("simhash", near_copies), ("decontam", leaks), ("mixing", mix)]
STAGES: list[tuple[str, Stage]] = [(name, _stage(i, work)) for i, (name, work) in enumerate(_WORK)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What the result reads from stays until the process ends, whatever runs after it."""
    docs = common.documents(spark, sf_dir)
    scratch = common.Scratch(spark, "pipeline")
    for i, (name, work) in enumerate(_WORK):
        docs, made = _watched(work, spark, docs, sf_dir)
        if i < len(_WORK) - 1:
            docs = scratch.put(docs, name)
            common.release(made)
            if i:
                scratch.drop(_WORK[i - 1][0])
    return docs
