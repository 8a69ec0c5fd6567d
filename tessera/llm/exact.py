"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when they are identical after deleting ``[\\x20\\x09-\\x0D]``. The key of a text is the
XXH64 of those bytes; the directory maps leading key bits to buckets.

1. A first pass counts bytes by key prefix. Starting from one bucket, every overfull bucket is split
   by its next bit; a split of a bucket as deep as the directory doubles the directory.
2. A second pass combines copies within each input partition and deals one entry a text to the
   bucket's owner task. An owner owns whole buckets, so key ranges; in key order it chains the
   entries of a key, comparing bytes, so texts that collide get chains of their own.
3. The chains are the index: Parquet in the shared folder, one row a text with the row that stays
   (most code points, then smallest id), the group's size and the digest.

A hot text reaches its owner once an input partition, not once a row. Rows find their group by
joining key and digest with the index; Spark splits the hot side of that join.

Defined cases: a null text is empty; null ids sort last; of rows equal in id and length one stays;
an empty table gives no rows; extra columns are carried, whatever their names; a very long text is an entry like any
other and is held whole by the task that compares it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import common

SPACE = b" \t\n\x0b\x0c\r"
#: Key bits that are counted; buckets are split further by bits beyond them. So many buckets at most; they grow beyond it.
PREFIX_BITS, MOST_BUCKETS = 16, 1 << 20
#: A bucket above so many bytes of text is split; small inputs still get this many buckets a partition.
BUCKET_BYTES, BUCKETS_A_PARTITION, LEAST_BUCKET = 8 << 20, 4, 32 << 10
#: Bytes of texts known to repeat that a task holds back, to send them once.
HELD_BYTES = 32 << 20
#: Bytes of text whose rows a task writes, where there are more tasks than cores: each file costs an executor processes of its own.
FILE_BYTES = 32 << 20


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, SPACE)


def _key(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = np.zeros(1 << PREFIX_BITS, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            data = normalised(text)
            size[_key(data) >> (64 - PREFIX_BITS)] += len(data) + 64
    some = np.flatnonzero(size)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(size[some])], names=["prefix", "bytes"])


def directory(sizes: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Global depth and the buckets as (prefix, local depth), by splitting from one bucket on."""
    total = np.zeros((1 << PREFIX_BITS) + 1, np.int64)
    for prefix, n in sizes.items():
        total[prefix + 1] = n
    total = total.cumsum()
    deep, done, todo = 0, [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        wide = PREFIX_BITS - depth
        held = total[(prefix + 1) << wide] - total[prefix << wide]
        if held > capacity and wide:
            deep = max(deep, depth + 1)
            todo += [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
        else:  # beyond the counted bits the halves are taken to be alike
            more = max(0, math.ceil(math.log2(max(1, held) / max(1, capacity)))) if not wide else 0
            deep = max(deep, depth + more)
            done += [((prefix << more) + i, depth + more) for i in range(1 << more)]
    return deep, sorted(done, key=lambda b: b[0] << (64 - b[1]))


def _better(a: tuple[int, Any], b: tuple[int, Any]) -> bool:
    """Whether a row (code points, id) stays rather than another."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def _combine(bounds: np.ndarray):
    """Entries: one row a text of the partition (texts that do not repeat at once, others held back)."""

    def out(rows: list[pa.RecordBatch], made: list[tuple[int, int]]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        keys = np.array([k for k, _ in made], np.uint64)
        bucket = np.searchsorted(bounds, keys, "right") - 1
        return pa.RecordBatch.from_arrays([*table.columns, pa.array(bucket.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array([n for _, n in made], pa.int64())], names=[*table.schema.names, "bucket", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        room = HELD_BYTES
        for batch in (x for b in batches for x in common.chunks(b, "text")):
            found: dict[bytes, list] = {}
            for i, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                data, rank = normalised(text), (len(text), own)
                if (entry := found.get(data)) is None:
                    found[data] = [1, rank, i]
                else:
                    entry[0] += 1
                    if _better(rank, entry[1]):
                        entry[1:] = [rank, i]
            take, made = [], []
            for data, (n, rank, i) in found.items():
                if (old := held.get(data)) is not None:
                    old[0] += n
                    if _better(rank, old[1]):
                        old[1:] = [rank, batch.take(pa.array([i]))]
                elif n > 1 and room > len(data) * 3:
                    held[data] = [n, rank, batch.take(pa.array([i]))]
                    room -= len(data) * 3
                else:
                    take.append(i)
                    made.append((_key(data), n))
            if take:
                yield out([batch.take(pa.array(take))], made)
        if held:
            yield out([x[2] for x in held.values()], [(_key(k), x[0]) for k, x in held.items()])

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner: entries in key order to one row a text."""
    key, chain = None, []  # of the key: [bytes, n, rank, batch, row]

    def out(closed: list[tuple[int, int, list]], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = [x for x in closed if x[2][3] is batch]
        for part, rows in ([(batch.take(pa.array([x[2][4] for x in own])), own)] if own else []) + [(x[2][3].slice(x[2][4], 1), [x]) for x in closed if x[2][3] is not batch]:
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in ("id", "text", "row", "key")],
                    pa.array([x[1] for x in rows], pa.int32()),
                    pa.array([x[2][1] for x in rows], pa.int64()),
                    pa.array([x[2][2][0] for x in rows], pa.int64()),
                    pa.array([hashlib.sha256(x[2][0]).hexdigest() for x in rows], pa.string()),
                ],
                names=["id", "text", "row", "key", "chain", "group_size", "n_points", "text_sha256"],
            )

    last = None
    for batch in batches:
        last, closed = batch, []
        for i, (k, n, text, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "n", "text", "id")), strict=True)):
            if k != key:
                closed += [(key, j, x) for j, x in enumerate(chain)]
                key, chain = k, []
            data, rank = normalised(text), (len(text), own)
            for x in chain:
                if x[0] == data:
                    x[1] += n
                    if _better(rank, x[2]):
                        x[2:] = [rank, batch, i]
                    break
            else:
                chain.append([data, n, rank, batch, i])
        yield from out(closed, batch)
        chain = [[*x[:3], x[3].slice(x[4], 1), 0] for x in chain]
    if last is not None and chain:
        yield from out([(key, j, x) for j, x in enumerate(chain)], last)


def build_index(docs: DataFrame, scratch: common.Scratch, doc: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """The index: id, text, row (a struct: whether the text was null, then the columns in ``carry`` as c0, c1, ..), key, chain, group_size, n_points, text_sha256.

    Also the number of tasks that tables of these documents are written by, at most.
    """
    spark = docs.sparkSession
    plain = docs.select(common.as_text(text).alias("text"))
    sizes = plain.mapInArrow(common.small(_profile), "prefix int, bytes long").groupBy("prefix").agg(F.sum("bytes").alias("bytes")).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    total = sum(r["bytes"] for r in sizes)
    files = max(spark.sparkContext.defaultParallelism, math.ceil(total / FILE_BYTES))
    capacity = max(LEAST_BUCKET, min(BUCKET_BYTES, total // (BUCKETS_A_PARTITION * parts)), total // MOST_BUCKETS)
    _, buckets = directory({r["prefix"]: r["bytes"] for r in sizes}, capacity)
    bounds = np.array([p << (64 - d) if d else 0 for p, d in buckets], np.uint64)
    rows = docs.select(F.col(doc).alias("id"), common.as_text(text).alias("text"), F.struct(F.col(text).isNull().alias("was_null"), *[common.column(c).alias(f"c{i}") for i, c in enumerate(carry or [])]).alias("row"))
    entries = rows.mapInArrow(_combine(bounds), common.extended(rows, "bucket int, key long, n long")).repartition("bucket").sortWithinPartitions("key")
    return scratch.put(entries.mapInArrow(_chain, common.extended(rows, "key long, chain int, group_size long, n_points long, text_sha256 string")).coalesce(files), "index"), files


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        data = [normalised(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([_signed(_key(d)) for d in data], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())],
            names=["doc_id", "points", "key", "text_sha256"],
        )


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = common.Scratch(docs.sparkSession, "exact")
    index, files = build_index(docs, scratch, doc, text)
    index = index.select("key", "text_sha256", "group_size", F.col("id").alias("keep_id"))
    rows = docs.select(F.col(doc).alias("id"), common.as_text(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(common.small(_digests), f"doc_id {kind}, points long, key long, text_sha256 string")
    found = scratch.put(found.withColumn("row", F.monotonically_increasing_id()).coalesce(files), "digests")
    # which of the rows that are equal in id and length stays; combined within each task first
    stays = found.groupBy("key", "text_sha256").agg(F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    known = scratch.put(index.join(stays.select("key", "text_sha256", F.col("first.row").alias("kept_row")), ["key", "text_sha256"]).coalesce(files), "known")
    return found.join(known, ["key", "text_sha256"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("kept_row")).alias("kept"), "text_sha256").coalesce(files)


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    others = [c for c in docs.columns if c != text]
    index, _ = build_index(docs, common.Scratch(docs.sparkSession, "exact"), doc, text, others)
    back = F.when(~F.col("row.was_null"), F.col("text").cast(docs.schema[text].dataType)).alias(text)
    return index.select(*[back if c == text else F.col("row").getField(f"c{others.index(c)}").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.documents(spark, sf_dir))


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), g as (
  select *, first_value(doc_id) over w as keep_id, row_number() over w as place, count(*) over (partition by text_sha256) as group_size
  from d window w as (partition by text_sha256 order by points desc, doc_id nulls last)
)
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from g
"""
