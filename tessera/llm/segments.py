"""Repeated windows of a corpus, found by way of segments. Shared by word and byte deduplication.

A window is ``length`` consecutive units (words or bytes) of one text. Its key is the smallest hash of
the ``gram``-unit strings in it, so equal windows have equal keys; a segment is a run of windows with
one key at one place, so at most ``length - gram + 1`` of them. Only the segments go through shuffles, about two for every ``length - gram`` units:

1. segments whose key occurs once anywhere are dropped;
2. equal segments are counted, with one place where their content stands;
3. a key with one segment is settled: all its windows repeat as often as the segment;
4. segments of the other keys are fetched and compared window by window, by the caller's kernel, whole
   keys to a task; keys above ``HOT_SEGMENTS`` segments, which a very frequent line or passage makes,
   go window by window to the whole cluster instead (the caller's ``spread``), with the same result;
5. what is known of a segment goes back to all its occurrences, and from there to the documents.

Equal ids and texts are one key of a document, so repeated rows count as occurrences and get the same
ranges. A long text is cut in overlapping pieces of ``CHUNK`` bytes, so what a task holds of it is a small multiple of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm import common

HOT_SEGMENTS = 256
CHUNK = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What a text is made of: words (``words``) or bytes, in windows of ``length``, keyed by ``gram``."""

    words: bool
    length: int
    gram: int


class Hasher:
    """Hashes of all byte ranges of a buffer, by prefix sums modulo 2**64."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 63)) * 8 + 5 & 0xFFFFFFFFFFFFFFFF
        self.power = self.inverse = np.empty(0, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(self.power) < len(data) + 1:
            n = max(CHUNK, len(data)) + 1
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(self.base, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(self.table[data] * self.power[: len(data)], dtype=np.uint64)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


#: White space between words, as bytes.split() knows it, to blanks.
_BLANKED = bytes(32 if i in b" \t\n\x0b\x0c\r" else i for i in range(256))


def joined(text: str) -> bytes:
    """The words of a text with one space between. Long texts are not taken apart, which would cost an object a word."""
    data = encode(text)
    if len(data) <= CHUNK:
        return b" ".join(data.split())
    data = data.translate(_BLANKED)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.strip(b" ")


def word_ends(data: bytes) -> np.ndarray:
    """Where each word of joined words ends."""
    return np.r_[np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data)] if data else np.empty(0, np.int64)


def cut(data: list[bytes], unit: Unit, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Segments of texts (words joined, or bytes): text number, first window, windows, key, hash of the content."""
    none = np.empty(0, np.int64)
    if unit.words:
        buffer = b" ".join(x for x in data if x)
        ends = word_ends(buffer)
        starts = np.r_[0, ends[:-1] + 1]
        first = np.r_[0, np.cumsum([x.count(b" ") + 1 if x else 0 for x in data], dtype=np.int64)]
    else:
        buffer = b"".join(data)
        starts = np.arange(len(buffer))
        ends, first = starts + 1, np.r_[0, np.cumsum([len(x) for x in data], dtype=np.int64)]
    if first[-1] < unit.length:
        return none, none, none, none.astype(np.uint64), []
    hasher.load(np.frombuffer(buffer, np.uint8))
    last = len(starts) - unit.gram + 1
    width = unit.length - unit.gram + 1
    grams = hasher.of(starts[:last], ends[unit.gram - 1 :])
    key = sliding_min(grams, width)
    text = np.repeat(np.arange(len(data)), np.diff(first))
    at = np.flatnonzero(text[: len(key)] == text[unit.length - 1 :])
    if not len(at):
        return none, none, none, none.astype(np.uint64), []
    # a new segment also where the smallest string comes in once more: what repeats within a text has two segments
    key, enters = key[at], grams[at + width - 1] == key[at]
    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1]) | enters[1:]])
    n = np.diff(np.r_[begin, len(at)])
    window, view = at[begin], memoryview(buffer)
    ranges = zip(starts[window].tolist(), ends[window + n + unit.length - 2].tolist(), strict=True)
    content = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in ranges]
    own = text[window]
    return own, window - first[own], n, key[begin], content


def pieces(text: str, unit: Unit) -> Iterator[tuple[int, bytes]]:
    """A long text in pieces of about ``CHUNK`` bytes, with the unit that each begins at; a window is in one of them."""
    data = joined(text) if unit.words else encode(text)
    if not unit.words:
        for a in range(0, max(1, len(data) - unit.length + 1), CHUNK):
            yield a, data[a : a + CHUNK + unit.length - 1]
        return
    ends = word_ends(data)
    a = 0
    while a == 0 or a + unit.length <= len(ends):
        begin = int(ends[a - 1]) + 1 if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + CHUNK)))  # the first word of the next piece
        yield a, data[begin : int(ends[min(len(ends), b + unit.length - 1) - 1]) if len(ends) else 0]
        a = b


def _members(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def out(part: pa.RecordBatch, found: tuple, shift: int = 0) -> pa.RecordBatch:
            own, at, n, key, content = found
            row = pa.array(own)
            return pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64)), part.column("dk").take(row), part.column("doc").take(row), pa.array((at + shift).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["fp", "seg", "dk", "doc", "pos", "n"],
            )

        for part in (x for b in batches for x in common.chunks(b, "text", CHUNK)):
            texts = part.column("text").to_pylist()
            if len(texts) == 1 and len(texts[0]) > CHUNK:
                for first, data in pieces(texts[0], unit):
                    yield out(part, cut([data], unit, hasher), first)
            else:
                yield out(part, cut([joined(t) if unit.words else encode(t) for t in texts], unit, hasher))

    return run


def _content(unit: Unit):
    """The bytes of the segments that stand in each text. Rows equal in id and text lie side by side and give them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for i, key in enumerate(batch.column("dk").to_pylist()):
                if key == before:
                    continue
                before = key
                part = batch.slice(i, 1)
                wanted = part.column("wanted").flatten()
                text = part.column("text")[0].as_py()
                pos, n = wanted.field("pos").to_numpy().astype(np.int64), wanted.field("n").to_numpy()
                if unit.words:
                    data = joined(text)
                    ends = word_ends(data)
                    starts, stops = np.r_[0, ends[:-1] + 1][pos], ends[pos + n + unit.length - 2]
                else:
                    data, starts, stops = encode(text), pos, pos + n + unit.length - 1
                found = [data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(wanted.field(c) for c in ("fp", "seg", "n", "members", "first", "segs")), pa.array(found, pa.binary())], names=["fp", "seg", "n", "members", "first", "segs", "data"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for part in run(batches):
            waiting.append(part)
            rows += part.num_rows
            if rows > 4000:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, rows = [], 0
        yield from waiting

    return gathered


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """dk, doc, text: the rows as the steps know them."""
    rows = docs.select(F.col(doc).alias("doc"), common.as_text(text).alias("text"))
    return rows.select(F.xxhash64("doc", "text").alias("dk"), "doc", "text")


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def ranges(rows: DataFrame, unit: Unit, kernel: Kernel, spread: Callable[[DataFrame, common.Scratch], DataFrame], scratch: common.Scratch, ordered: bool) -> DataFrame:
    """dk, doc, runs (array of start and n): the windows of each document that occur elsewhere.

    With ``ordered``, those that also start in a document with a smaller id; a null id is the largest.
    ``kernel`` maps rows (fp, seg, n, members, first, segs, data), whole keys in order, and ``spread`` a
    frame of them, to (fp, seg, runs of at, n, first): the windows that repeat, with the smallest id.
    """
    kind = rows.schema["doc"].dataType.simpleString()
    run_kind = f"array<struct<at: int, n: int, first: {kind}>>"
    members = scratch.put(rows.mapInArrow(_members(unit), f"fp long, seg long, dk long, doc {kind}, pos int, n int"), "members")
    again = scratch.put(members.groupBy("fp").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > 1).select("fp"), "keys")
    members = scratch.put(members.join(again, "fp", "left_semi"), "again")
    scratch.drop("members")
    segs = members.groupBy("fp", "seg").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("members"), F.min("doc").alias("first"), F.min("dk").alias("dk"), F.min_by("doc", "dk").alias("doc"), F.min_by("pos", "dk").alias("pos")
    )
    segs = scratch.put(segs, "segs")
    # a table of its own, so that Spark can split the rows of a frequent key in the join
    kinds = scratch.put(segs.groupBy("fp").agg(F.count(F.lit(1)).alias("segs")), "kinds")
    segs = scratch.put(segs.join(kinds, "fp"), "kinded")
    scratch.drop("segs")
    settled = segs.where(F.col("segs") == 1).select("fp", "seg", F.array(F.struct(F.lit(0).alias("at"), "n", "first")).alias("runs"))
    wanted = F.collect_list(F.struct("fp", "seg", "pos", "n", "members", "first", "segs")).alias("wanted")
    places = segs.where(F.col("segs") > 1).groupBy("dk", F.col("doc").alias("_doc")).agg(wanted).withColumnRenamed("dk", "_dk")
    texts = rows.join(places, (F.col("dk") == F.col("_dk")) & F.col("doc").eqNullSafe(F.col("_doc")))
    shape = f"fp long, seg long, n int, members long, first {kind}, segs long, data binary"
    content = scratch.put(texts.select("dk", "text", "wanted").mapInArrow(common.small(_content(unit)), shape), "content")
    known = content.where(F.col("segs") <= HOT_SEGMENTS).repartition("fp").sortWithinPartitions("fp", "seg").mapInArrow(kernel, f"fp long, seg long, runs {run_kind}")
    found = scratch.put(known.unionByName(spread(content.where(F.col("segs") > HOT_SEGMENTS).dropDuplicates(["fp", "seg"]), scratch)).unionByName(settled), "found")
    scratch.drop("content")
    covers = F.lit(True)
    if ordered:
        covers = lambda r: F.coalesce(r["first"] < F.col("doc"), r["first"].isNotNull() & F.col("doc").isNull())
    runs = F.filter("runs", covers) if ordered else F.col("runs")
    placed = F.transform(runs, lambda r: F.struct((F.col("pos") + r["at"]).alias("start"), r["n"].alias("n")))
    each = members.join(found, ["fp", "seg"]).select("dk", "doc", placed.alias("runs")).where(F.size("runs") > 0)
    # a set, made within each task first: rows equal in id and text have the same runs
    return scratch.put(each.groupBy("dk", "doc").agg(F.flatten(F.collect_set("runs")).alias("runs")), "ranges")


def with_ranges(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc, text, runs (null where nothing repeats)."""
    other = found.select(F.col("dk").alias("_dk"), F.col("doc").alias("_doc"), "runs")
    return rows.join(other, (F.col("dk") == F.col("_dk")) & F.col("doc").eqNullSafe(F.col("_doc")), "left").select("doc", "text", "runs")


def covered(runs: pa.Scalar, length: int) -> list[tuple[int, int]]:
    """Start and end of the stretches of units that the windows of a text's runs cover."""
    if not runs.is_valid or not len(runs.values):
        return []
    start = runs.values.field("start").to_numpy().astype(np.int64)
    end = start + runs.values.field("n").to_numpy() + (length - 1)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist(), strict=True))


def between(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The stretches of 0 to ``n`` that the spans leave."""
    edge = [0, *(x for span in spans for x in span), n]
    return [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if a < b]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def whole_keys(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in key order, in parts of about ``most`` bytes of data that hold whole keys."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.column("data").nbytes
        if size >= most:
            all_ = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            fp = all_.column("fp").to_numpy()
            whole = int(np.searchsorted(fp, fp[-1]))
            if whole:
                yield all_.slice(0, whole)
                waiting = [pa.Table.from_batches([all_.slice(whole)]).combine_chunks().to_batches()[0]]
                size = waiting[0].column("data").nbytes
    if size or waiting:
        yield from (x for x in pa.Table.from_batches(waiting).combine_chunks().to_batches())
