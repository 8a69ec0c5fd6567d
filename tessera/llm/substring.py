"""Removal of repeated phrases with Aho-Corasick automata.

A window is ``LENGTH`` consecutive words of one text. :mod:`segments` finds where windows can repeat.
Shards of it, whole keys each, then confirm and locate them on the words themselves: windows that
stand in more than one segment are phrases, a shard's phrases are compiled into one automaton over
word numbers, and all of the shard's segments stream through it; each match gives the smallest id of
a document that has the phrase. A word goes when a window that covers it also starts in a document
with a smaller id.

Defined cases: null texts have no words; ids that are null are larger than all others; rows equal in id
never remove each other's words; windows that lie in the text twice count once; texts shorter than a
window are kept; an empty table gives no rows; other columns are not read; very long texts are cut in
overlapping pieces, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import common, segments

LENGTH, GRAM = 13, 6
UNIT = segments.Unit(True, LENGTH, GRAM)
#: Bytes of segments that one automaton is made for.
SHARD_BYTES = 2 << 20


def _smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


def _locate(rows: list[tuple[int, int, object, list[bytes]]]) -> Iterator[tuple[int, int, list[dict]]]:
    """Of a shard's segments (key, segment, smallest id, words): the runs of windows by smallest id."""
    numbers: dict[bytes, int] = {}
    lists = [tuple(numbers.setdefault(w, len(numbers)) for w in words) for _, _, _, words in rows]
    seen: dict[tuple[int, ...], list] = {}
    for (_, _, first, _), own in zip(rows, lists, strict=True):
        for i in range(len(own) - LENGTH + 1):
            if (entry := seen.get(phrase := own[i : i + LENGTH])) is None:
                seen[phrase] = [first, False]
            else:
                entry[0], entry[1] = _smaller(entry[0], first), True
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, (first, twice) in seen.items():
        if twice:
            automaton.add_word(phrase, (first,))
    del seen
    if len(automaton):
        automaton.make_automaton()
    for (fp, seg, first, _), own in zip(rows, lists, strict=True):
        ids = [first] * (len(own) - LENGTH + 1)
        if len(automaton):
            for end, (value,) in automaton.iter(own):
                ids[end - LENGTH + 1] = value
        runs: list[dict] = []
        for i, x in enumerate(ids):
            if runs and runs[-1]["first"] == x:
                runs[-1]["n"] += 1
            else:
                runs.append({"at": i, "n": 1, "first": x})
        yield fp, seg, runs


def _kernel(kind: pa.DataType):
    shape = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("first", kind)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segments.whole_keys(batches, SHARD_BYTES):
            columns = (part.column(c).to_pylist() for c in ("fp", "seg", "first", "data"))
            rows = {(fp, seg): (fp, seg, first, data.split(b" ")) for fp, seg, first, data in zip(*columns, strict=True)}
            found = list(_locate(list(rows.values())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], shape)], names=["fp", "seg", "runs"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of a segment, by its 128-bit hash."""
    for batch in batches:
        one, two, row, at = [], [], [], []
        for i, data in enumerate(batch.column("data").to_pylist()):
            sizes = np.fromiter(map(len, data.split(b" ")), np.int64)
            ends = np.cumsum(sizes + 1) - 1
            for k, (a, b) in enumerate(zip((ends - sizes)[: len(ends) - LENGTH + 1].tolist(), ends[LENGTH - 1 :].tolist(), strict=True)):
                h = xxhash.xxh3_128_intdigest(data[a:b])
                one.append(h & 0x7FFFFFFFFFFFFFFF)
                two.append(h >> 65)
                row.append(i)
                at.append(k)
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), *(batch.column(c).take(take) for c in ("fp", "seg", "first")), pa.array(at, pa.int32())], names=["h1", "h2", "fp", "seg", "first", "at"])


def _spread(hot: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Very frequent keys: the same, with one row a window instead of an automaton."""
    kind = hot.schema["first"].dataType.simpleString()
    rows = scratch.put(hot.mapInArrow(_windows, f"h1 long, h2 long, fp long, seg long, first {kind}, at int"), "windows")
    least = scratch.put(rows.groupBy("h1", "h2").agg(F.min("first").alias("least")), "least")
    runs = F.sort_array(F.collect_list(F.struct("at", F.lit(1).alias("n"), F.col("least").alias("first"))))
    return rows.join(least, ["h1", "h2"]).groupBy("fp", "seg").agg(runs.alias("runs"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, digest, kept = [], [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs"), strict=True):
            data = segments.joined(text)
            n = data.count(b" ") + 1 if data else 0
            if spans := segments.covered(runs, LENGTH):
                ends = segments.word_ends(data)
                data = b" ".join(data[int(ends[a - 1]) + 1 if a else 0 : int(ends[b - 1])] for a, b in segments.between(spans, n))
            total.append(n)
            gone.append(sum(b - a for a, b in spans))
            digest.append(hashlib.sha256(data).hexdigest())
            kept.append(data)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: what is left of each text, words joined by one space."""
    scratch = common.Scratch(docs.sparkSession, "substring")
    rows = segments.keyed(docs, doc, text)
    kind = rows.schema["doc"].dataType
    arrow = pa.string() if kind.simpleString() == "string" else pa.int64() if kind.simpleString() == "bigint" else pa.int32()
    found = segments.ranges(rows, UNIT, _kernel(arrow), _spread, scratch, ordered=True)
    shape = f"doc_id {kind.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept string"
    return segments.with_ranges(rows, found).mapInArrow(common.small(_keep), shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(common.documents(spark, sf_dir)).drop("kept")
