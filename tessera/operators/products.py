"""Top-k inner products of sparse and of dense vectors, in blocks of queries and of the pool.

Blocks are dealt by hash within a shard (a country, say), so a large shard is many tasks and what one
holds has a bound. No pair becomes a row unless it is among the ``top`` of its query and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera import session

#: Rows of the pool and of the queries that a block holds, and products that a step adds up.
POOL_BLOCK, QUERY_BLOCK, STEP = 20_000, 10_000, 1 << 22


def ranked(scored: DataFrame, top: int | Column) -> DataFrame:
    """The first ``top`` of each query with their rank; ties by tid."""
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "tid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def records_of(best: DataFrame, kinds: DataFrame, members: DataFrame, top: int | Column) -> DataFrame:
    """qid, tid, score, rank of the records behind each query's best kinds of records.

    ``best`` (qid, tid, score) names a kind by its smallest id, as do ``kinds`` (tid, copies, and what a column
    ``top`` reads) and ``members`` (kind, tid: the first records of each). Records of a kind score alike, so a kind
    below others that hold ``top`` records, all with larger scores, has none of the best.
    """
    w = W.partitionBy("qid").orderBy(F.col("score").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    before = F.sum("copies").over(w) - F.sum("copies").over(W.partitionBy("qid", "score"))
    here = best.select("qid", "tid", "score").join(session.unsent(kinds), "tid").withColumn("_before", before).withColumn("_top", top if isinstance(top, Column) else F.lit(top))
    asked = here.where(F.col("_before") < F.col("_top")).select("qid", F.col("tid").alias("kind"), "score", "_top")
    found = asked.join(session.unsent(members), "kind").select("qid", "tid", "score", "_top")
    return ranked(found, F.col("_top") if isinstance(top, Column) else top).drop("_top")


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, feature and unit-length weight of every entry."""
    lists = table.column("v").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    entries = lists.flatten()
    w = entries.field("w").to_numpy(zero_copy_only=False).astype(float)
    norm = np.sqrt(np.bincount(owner, w * w, len(lists)))
    return owner, entries.field("g").to_numpy(zero_copy_only=False), w / norm[owner]


def best_of(scores: np.ndarray, top: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``top`` scores above ``least``; ties go to the lower column."""
    n = scores.shape[1]
    if n > top:
        cut = np.partition(scores, n - top, axis=1)[:, n - top]
        row, column = np.nonzero((scores >= cut[:, None]) & (scores > least))
    else:
        row, column = np.nonzero(scores > least)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return row[place < top], column[place < top]


def _block(schema: pa.Schema):
    def run(queries: pa.Table, pool: pa.Table) -> pa.Table:
        if not len(queries) or not len(pool):
            return schema.empty_table()
        pool = pool.sort_by("tid")
        top, least = int(queries.column("top")[0].as_py()), float(queries.column("least")[0].as_py())
        owner, feature, weight = _flat(pool)
        order = np.argsort(feature, kind="stable")
        owner, feature, weight = owner[order], feature[order], weight[order]
        known, start = np.unique(feature, return_index=True)
        ends = np.r_[start[1:], len(feature)]
        asker, wanted, importance = _flat(queries)
        place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        hit = known[place] == wanted
        asker, place, importance = asker[hit], place[hit], importance[hit]
        many = (ends - start)[place]
        parts = []
        # steps of whole queries, with a bound on the products and on the table of scores
        at_query = np.searchsorted(asker, np.arange(len(queries) + 1))
        work = np.r_[0, many.cumsum()][at_query]
        lo = 0
        while lo < len(queries):
            hi = min(int(np.searchsorted(work, work[lo] + STEP, "right")) - 1, lo + max(1, STEP // len(pool)))
            hi = min(len(queries), max(lo + 1, hi))
            own = slice(at_query[lo], at_query[hi])
            n = many[own]
            entry = np.repeat(start[place[own]], n) + np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            cell = np.repeat(asker[own] - lo, n) * len(pool) + owner[entry]
            scores = np.bincount(cell, np.repeat(importance[own], n) * weight[entry], (hi - lo) * len(pool))
            scores = np.round(scores.reshape(hi - lo, len(pool)), 6)
            row, column = best_of(scores, top, least)
            parts.append((row + lo, column, scores[row, column]))
            lo = hi
        row, column, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pa.table([queries.column("qid").take(pa.array(row)), pool.column("tid").take(pa.array(column)), pa.array(score)], schema=schema)

    return run


def sparse(queries: DataFrame, pool: DataFrame, top: int | Column = 100, least: float | Column = 0.0, pool_block: int = POOL_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """qid, tid, score, rank within a shard; queries (shard, qid, v) against pool (shard, tid, v), v an array of (g, w).

    Vectors are scaled to unit length, scores rounded to 6 digits before they rank; ``top`` and ``least``
    may be columns of the shard.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)

    def dealt(rows: DataFrame, key: str, size: int, own: str, other: str, sizes: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other)
        place = F.pmod(F.xxhash64(F.lit(3), key), F.col(f"n_{own}")).cast("int").alias(own)
        return rows.join(sizes, "shard").select("shard", key, "v", place, every)

    count = lambda rows, size, name: rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = count(queries, query_block, "n_qb").join(count(pool, pool_block, "n_pb"), "shard")
    left = dealt(queries, "qid", query_block, "qb", "pb", sizes).withColumn("top", as_column(top)).withColumn("least", as_column(least).cast("double"))
    right = dealt(pool, "tid", pool_block, "pb", "qb", sizes)
    kinds = {"qid": queries.schema["qid"].dataType, "tid": pool.schema["tid"].dataType}
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([*((k, arrow[v.simpleString()]) for k, v in kinds.items()), ("score", pa.float64())])
    found = left.groupBy("shard", "qb", "pb").cogroup(right.groupBy("shard", "qb", "pb")).applyInArrow(_block(schema), f"qid {kinds['qid'].simpleString()}, tid {kinds['tid'].simpleString()}, score double")
    limit = top if not isinstance(top, Column) else F.col("_top")
    if isinstance(top, Column):
        tops = left.select("qid", F.col("top").alias("_top")).distinct()
        return ranked(found.join(tops, "qid"), limit).drop("_top")
    return ranked(found, limit)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def dense(queries: DataFrame, pool: DataFrame, top: int = 50, query_block: int = 4096) -> DataFrame:
    """qid, tid, score, rank; queries (qid, v) against pool (tid, v).

    A pass over the pool holds ``query_block`` queries, and of what it has seen each query's best ``top``:
    more queries take more passes. Only the queries go to the driver, a block at a time.
    """
    spark, out = queries.sparkSession, None
    blocks = -(-queries.count() // query_block)
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *pool.schema)}
    shape = f"qid {kinds['qid']}, tid {kinds['tid']}, score double"
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if own:
            part = pool.select("tid", "v").mapInPandas(_dense_block([r["qid"] for r in own], unit(np.array([r["v"] for r in own], np.float64)), top), shape)
            out = part if out is None else out.unionByName(part)
    return ranked(out if out is not None else spark.createDataFrame([], shape), top)


def _dense_block(ids: list, wanted: np.ndarray, top: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_score = np.empty((len(ids), 0))
        held_tid = np.empty((len(ids), 0), object)
        for part in (p.iloc[i : i + 1024] for p in parts for i in range(0, len(p), 1024)):
            part = part.sort_values("tid")
            score = np.round(wanted @ unit(np.stack(part["v"].to_numpy()).astype(np.float64)).T, 6)
            score, tid = np.c_[held_score, score], np.c_[held_tid, np.broadcast_to(part["tid"].to_numpy().astype(object), score.shape)]
            order = np.empty((len(ids), min(top, score.shape[1])), np.int64)
            for i in range(len(ids)):
                own = score[i]
                some = np.flatnonzero(own >= np.partition(own, len(own) - top)[len(own) - top]) if len(own) > top else np.arange(len(own))
                some = some[np.lexsort((np.argsort(np.argsort(tid[i, some])), -own[some]))]
                order[i] = some[: order.shape[1]]
            held_score, held_tid = np.take_along_axis(score, order, 1), np.take_along_axis(tid, order, 1)
        if held_score.shape[1]:
            n = held_score.shape[1]
            yield pd.DataFrame({"qid": np.repeat(np.array(ids, object), n), "tid": held_tid.ravel(), "score": held_score.ravel()}).infer_objects()

    return run
