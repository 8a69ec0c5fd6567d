"""Removal of repeated byte strings with suffix arrays.

A window is ``LENGTH`` bytes of one text. :mod:`segments` finds where windows can repeat; the
segments to compare are cut, in key order, into shards of about ``SHARD_BYTES``. A shard's suffix array
comes from Larsson-Sadakane refinement (groups of equal ranks are sorted again by the rank as many
bytes further on as they already agree, doubling), its common prefixes from Kasai's relation: the
prefix of a suffix and its neighbour is at least that of the suffix before it less one, and exactly
that unless the bytes before them differ, so only those are compared. A window whose prefix with a
neighbour reaches ``LENGTH`` repeats. A key that goes on in the next shard is merged across: the one
shard's windows are looked up in the other's suffix array by binary search.

Defined cases: null texts have no bytes; a string that repeats within one text counts, overlapping too;
repeated rows repeat each other; texts shorter than a window are kept; an empty table gives no rows;
other columns are not read; very long texts are cut in overlapping pieces, with the same result. A cut within a character leaves bytes that are not UTF-8, so what is kept
is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import common, segments

LENGTH, GRAM = 200, 64
UNIT = segments.Unit(False, LENGTH, GRAM)
SHARD_BYTES = 512 << 10
#: Buckets that the windows of very frequent keys are dealt to, and windows gathered for one row.
BUCKETS, GATHERED = 512, 1 << 17
_RECORD = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("fp", "<i8"), ("seg", "<i8"), ("at", "<u4"), ("twice", "u1")])


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by Larsson-Sadakane refinement; the end sorts first."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    wide = np.r_[data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)]
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven bytes of nine bits
        key = (key << np.uint64(9)) | wide[i : i + n]
    order = np.argsort(key, kind="stable")
    head = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = place
    step = 7
    while True:
        size = np.diff(np.r_[np.flatnonzero(head), n])
        loose = np.flatnonzero(np.repeat(size > 1, size))
        if not len(loose):
            return order
        own = order[loose]
        after = rank[np.minimum(own + step, n)]
        new = np.lexsort((after, rank[own]))
        own, after, group = own[new], after[new], rank[own][new]
        order[loose] = own
        head[loose] = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        place = np.maximum.accumulate(np.where(head[loose], loose, 0))
        rank[own] = place
        step *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix, in order, shares with the one before it, up to ``most``."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    other = np.maximum(before, 0)
    fresh = (before < 0) | (at == 0) | (before == 0) | (data[at - 1] != data[other - 1])
    fresh[1:] |= before[1:] != before[:-1] + 1
    start = np.flatnonzero(fresh)
    long_ = np.zeros(len(start), np.int64)
    padded = np.r_[data.astype(np.int16), np.full(most + 64, -1, np.int16)]
    todo = np.flatnonzero(before[start] >= 0)
    # a suffix that ends has no next byte: its padding differs from the other's byte or padding
    view = sliding_window_view(padded, 32)
    open_, done = todo, 0
    while len(open_) and done < most + n:
        a, b = start[open_] + done, before[start[open_]] + done
        inside = (a < n) & (b < n)
        open_, a, b = open_[inside], a[inside], b[inside]
        if not len(open_):
            break
        more = []
        for lo in range(0, len(open_), 50_000):
            differ = (view[a[lo : lo + 50_000]] != view[b[lo : lo + 50_000]]) | (view[a[lo : lo + 50_000]] < 0)
            any_ = differ.any(axis=1)
            long_[open_[lo : lo + 50_000]] += np.where(any_, differ.argmax(axis=1), 32)
            more.append(~any_)
        open_ = open_[np.concatenate(more)]
        done += 32
    # the rest by Kasai's relation: one less than the suffix before
    run = np.maximum.accumulate(np.where(fresh, at, 0))
    value = np.zeros(n, np.int64)
    value[start] = long_
    return np.minimum(np.maximum(value[run] - (at - run), 0), most)[order]


class Shard:
    """Segments' bytes, their windows in suffix order, and which of them repeat."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]) -> None:
        self.rows = rows
        self.data = np.frombuffer(b"".join(x[3] for x in rows), np.uint8)
        sizes = np.array([len(x[3]) for x in rows], np.int64)
        self.first = np.r_[0, sizes.cumsum()]
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        room = self.first[self.owner + 1] - np.arange(len(self.data))
        window = room >= LENGTH
        self.again = np.zeros(len(self.data), bool)
        order = suffix_array(self.data)
        shared = common_prefixes(self.data, order)
        kept = np.flatnonzero(window[order])
        self.order = order[kept]
        if len(kept) > 1:
            # with windows left out between, the least of what lies between
            least = np.minimum.reduceat(shared, kept[:-1] + 1)
            last = kept[1:] - (kept[:-1] + 1)
            least = np.where(last == 0, shared[kept[1:]], np.minimum(least, shared[kept[1:]]))
            same = np.flatnonzero(least >= LENGTH)
            self.again[self.order[same]] = True
            self.again[self.order[same + 1]] = True
        self.view = sliding_window_view(self.data, LENGTH) if len(self.data) >= LENGTH else None
        self.keys = self._head(self.order)

    def _head(self, at: np.ndarray) -> np.ndarray:
        """The first eight bytes as a number that sorts alike."""
        key = np.zeros(len(at), np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | self.data[at + i].astype(np.uint64)
        return key

    def merge(self, other: Shard, fp: int) -> None:
        """Mark the windows of one key that stand in both shards."""
        mine = self.order[np.isin(self.owner[self.order], [i for i, x in enumerate(self.rows) if x[0] == fp])]
        for lo in range(0, len(mine), 20_000):
            at = mine[lo : lo + 20_000]
            key = self._head(at)
            low, high = np.searchsorted(other.keys, key, "left"), np.searchsorted(other.keys, key, "right")
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                a, b = self.view[at[open_]], other.view[other.order[middle]]
                differ = a != b
                unlike = differ.any(axis=1)
                where = differ.argmax(axis=1)
                greater = unlike & (a[np.arange(len(a)), where] > b[np.arange(len(b)), where])
                hit = ~unlike
                self.again[at[open_[hit]]] = True
                other.mark_like(middle[hit])
                low[open_[greater]] = middle[greater] + 1
                high[open_[unlike & ~greater]] = middle[unlike & ~greater]
                open_ = open_[unlike]
                open_ = open_[low[open_] < high[open_]]

    def mark_like(self, places: np.ndarray) -> None:
        """Mark windows by their places in the order. Equal neighbours have each other already."""
        self.again[self.order[places]] = True

    def found(self) -> Iterator[tuple[int, int, list[dict]]]:
        for i, (fp, seg, members, data) in enumerate(self.rows):
            n = len(data) - LENGTH + 1
            flags = self.again[self.first[i] : self.first[i] + n]
            runs = [(0, n)] if members > 1 else segments.runs_of(flags)
            if runs:
                yield fp, seg, [{"at": a, "n": b, "first": None} for a, b in runs]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    rows: list[tuple[int, int, int, bytes]] = []
    size, before = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("fp", "seg", "members", "data")), strict=True):
            if row[:2] == before:
                continue
            before = row[:2]
            rows.append(row)
            size += len(row[3])
            if size >= SHARD_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _kernel(kind: pa.DataType):
    shape = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("first", kind)]))

    def out(shards: list[Shard]) -> Iterator[pa.RecordBatch]:
        found = [x for s in shards for x in s.found()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], shape)], names=["fp", "seg", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[Shard] = []  # shards whose last key may go on
        for rows in _cut(batches):
            shard = Shard(rows)
            fp = rows[0][0]
            if open_ and open_[-1].rows[-1][0] != fp:
                yield from out(open_)
                open_ = []
            for other in open_:
                other.merge(shard, fp)
                shard.merge(other, fp)
            if rows[-1][0] != fp:
                yield from out(open_)
                open_ = []
            open_.append(shard)
        if open_:
            yield from out(open_)

    return run


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments, one of each kind, packed by bucket; windows that repeat here as bucket -1."""
    one, two = segments.Hasher(1), segments.Hasher(2)

    def pack(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        all_ = np.concatenate(parts)
        all_ = all_[np.lexsort((all_["h2"], all_["h1"]))]
        new = np.r_[True, (all_["h1"][1:] != all_["h1"][:-1]) | (all_["h2"][1:] != all_["h2"][:-1])]
        group = new.cumsum() - 1
        twice = (np.bincount(group) > 1) | (np.bincount(group, all_["twice"]) > 0)
        ones = all_[new]
        ones["twice"] = twice
        bucket = (ones["h1"] % BUCKETS).astype(np.int64)
        ones = ones[np.argsort(bucket, kind="stable")]
        size = np.bincount(bucket, minlength=BUCKETS)
        some, ends = np.flatnonzero(size), size.cumsum()
        blobs = [ones[ends[b] - size[b] : ends[b]].tobytes() for b in some] + [all_[twice[group]].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "records"])

    parts, waiting = [], 0
    for batch in batches:
        for fp, seg, members, data in zip(*(batch.column(c).to_pylist() for c in ("fp", "seg", "members", "data")), strict=True):
            at = np.arange(len(data) - LENGTH + 1)
            rows = np.empty(len(at), _RECORD)
            raw = np.frombuffer(data, np.uint8)
            for hasher, name in ((one, "h1"), (two, "h2")):
                hasher.load(raw)
                rows[name] = hasher.of(at, at + LENGTH)
            rows["fp"], rows["seg"], rows["at"], rows["twice"] = fp, seg, at, members > 1
            parts.append(rows)
            waiting += len(rows)
            if waiting >= GATHERED:
                yield from pack(parts)
                parts, waiting = [], 0
    if parts:
        yield from pack(parts)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, in order: the windows that another row has as well."""

    def solve(parts: list[bytes]) -> bytes:
        all_ = np.frombuffer(b"".join(parts), _RECORD)
        all_ = all_[np.lexsort((all_["h2"], all_["h1"]))]
        new = np.r_[True, (all_["h1"][1:] != all_["h1"][:-1]) | (all_["h2"][1:] != all_["h2"][:-1])]
        return all_[np.bincount(new.cumsum() - 1)[new.cumsum() - 1] > 1].tobytes()

    bucket, parts = None, []
    for batch in batches:
        done = []
        for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("records").to_pylist(), strict=True):
            if own != bucket and parts:
                done.append(solve(parts))
                parts = []
            bucket = own
            parts.append(blob)
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(done), pa.int32()), pa.array(done, pa.binary())], names=["bucket", "records"])
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([solve(parts)], pa.binary())], names=["bucket", "records"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to runs of windows of a segment."""
    for batch in batches:
        for blob in batch.column("records").to_pylist():
            rows = np.sort(np.frombuffer(blob, _RECORD)[["fp", "seg", "at"]], order=["fp", "seg", "at"])
            if not len(rows):
                continue
            new = np.r_[True, (rows["seg"][1:] != rows["seg"][:-1]) | (rows["fp"][1:] != rows["fp"][:-1]) | (rows["at"][1:] > rows["at"][:-1] + 1)]
            start = np.flatnonzero(new)
            end = rows["at"][np.r_[start[1:], len(rows)] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(rows["fp"][start]), pa.array(rows["seg"][start]), pa.array(rows["at"][start].astype(np.int32)), pa.array((end - rows["at"][start] + 1).astype(np.int32))], names=["fp", "seg", "at", "n"])


def _spread(hot: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Very frequent keys: windows by hash, over the whole cluster. Each task sends a window once."""
    kind = hot.schema["first"].dataType.simpleString()
    rows = scratch.put(hot.mapInArrow(_scatter, "bucket int, records binary"), "windows")
    met = rows.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "bucket int, records binary")
    found = rows.where("bucket < 0").unionByName(met).mapInArrow(_runs, "fp long, seg long, at int, n int")
    return found.groupBy("fp", "seg").agg(F.collect_list(F.struct("at", "n", F.lit(None).cast(kind).alias("first"))).alias("runs"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, spans, digest, kept = [], [], [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs"), strict=True):
            data = segments.encode(text)
            cuts = segments.covered(runs, LENGTH)
            left = b"".join(data[a:b] for a, b in segments.between(cuts, len(data))) if cuts else data
            total.append(len(data))
            gone.append(len(data) - len(left))
            spans.append([{"start": a, "length": b - a} for a, b in cuts])
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def remove(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and length of each removed run), kept_sha256, kept (binary)."""
    scratch = common.Scratch(docs.sparkSession, "suffix")
    rows = segments.keyed(docs, doc, text)
    kind = rows.schema["doc"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    found = segments.ranges(rows, UNIT, _kernel(arrow), _spread, scratch, ordered=False)
    shape = f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept_sha256 string, kept binary"
    return segments.with_ranges(rows, found).mapInArrow(common.small(_keep), shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
