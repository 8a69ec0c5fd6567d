"""Near-duplicates by SimHash with a Gray-order hierarchical index.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Fingerprints link
at ``RADIUS`` or fewer differing bits.

Candidates: two fingerprints within the radius agree on one of ``RADIUS + 1`` bit blocks, so every
distinct fingerprint goes to one group a block. A group above ``GROUP_ROWS`` goes on by blocks of its
remaining bits. Within a task the groups' fingerprints are sorted by Gray rank, which puts like
patterns side by side; nodes over ``FAN`` neighbours hold the bits that all of them share, and a
child only its bits beyond the parent's. A search adds up differences from the top and drops a whole
node once they exceed the radius. A task returns a spanning forest of its links, never the pairs.

A 64-bit fingerprint is too coarse for a similarity of 0.8: at that Jaccard similarity of shingles
about 10 of 64 bits differ, with a wide spread. Near-duplicate removal (:func:`deduplicate`) therefore
takes ``NEAR_LANES`` words of fingerprint from mixes of the same hash and links at ``NEAR_RADIUS`` bits.
Its groups are bands of bits. A band has as many bits as keep a group of unlike texts near ``GROUP_MEAN``
rows, and there are as many bands as let a pair at similarity 0.8 share none with probability
``MISSED`` (:func:`bands_for`), from further words if need be: the same recall at every size.

Components over distinct fingerprints come from contracting links; each round is a table in the shared
folder.

Defined cases: a null or wordless text has fingerprint 0, linked like any other; a text with fewer
words than a shingle is one shingle; null ids are never a component's id while it has another;
repeated rows are one document; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import common

SEED, RADIUS = 42, 3
WORDS, NEAR_WORDS = 3, 5
GROUP_ROWS, FAN = 4096, 8
#: 512 bits, of which 15 % differ at a Jaccard similarity of 0.8: 77 +- 8, so nearly all such pairs are within the radius.
NEAR_LANES, NEAR_RADIUS, NEAR_AGREE = 8, 100, 0.849
GROUP_MEAN, LEAST_BITS, MISSED = 256, 13, 0.007
#: Rows of whole groups that a task indexes at once, and candidate pairs that a search holds.
INDEX_ROWS, FRONTIER = 100_000, 1_000_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(rows: int) -> tuple[int, int, int]:
    """Bits of a band, bands, and words of fingerprint for so many texts."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, rows / GROUP_MEAN))))
    bands = math.ceil(math.log(MISSED) / math.log1p(-(NEAR_AGREE**bits)))
    return bits, bands, max(NEAR_LANES, -(-bits * bands // 64))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits from a hash; lane 0 is the hash itself."""
    if not lane:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, words: int = WORDS, lanes: int = 1) -> bytes:
    """The fingerprint, most significant byte first, in ``lanes`` words of 64 bits."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return bytes(8 * lanes)
    size = min(words, len(parts))
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1, initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[: len(parts) - size])]
    digests = b"".join(map(xxhash.xxh64_digest, map(joined.__getitem__, map(slice, starts, ends[size - 1 :])), repeat(SEED)))
    hashes = np.frombuffer(digests, ">u8").astype(np.uint64)
    out, n = b"", len(hashes)
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for i in range(0, n, 255 * 256):  # a byte of a sum holds up to 255
            bits = np.unpackbits(_mixed(hashes[i : i + 255 * 256], lane).astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
            sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
            counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * counts > n).tobytes()
    return out


def _prints(words: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words, lanes) for t in batch.column("text").to_pylist()]
            own = prints if lanes == 1 else [xxhash.xxh64_digest(x) for x in prints]
            vertex = np.frombuffer(b"".join(own), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(vertex), pa.array(prints, pa.binary())], names=["doc_id", "text_hash", "v", "fp"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each count."""
    ends = counts.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class GrayIndex:
    """Groups of fingerprints (rows of words), each under one root, in the order of group and Gray rank."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> None:
        self.radius = radius
        self.order = np.lexsort((*(gray_rank(fp[:, i]) for i in range(min(2, fp.shape[1]) - 1, -1, -1)), group))
        self.fp, group = fp[self.order], group[self.order]
        same, ones = self.fp, self.fp
        #: By level from the leaves: shared bits, their pattern, first child, children.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [(np.full(fp.shape, _ALL), self.fp, np.empty(0, np.int64), np.empty(0, np.int64))]
        while True:
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[start, len(group)])
            first = np.flatnonzero(_spread(sizes) % FAN == 0)
            same, ones = np.bitwise_and.reduceat(same, first), np.bitwise_or.reduceat(ones, first)
            mask = ~(same ^ ones)
            self.levels.append((mask, same & mask, first, np.diff(np.r_[first, len(group)])))
            group = group[first]
            if sizes.max() <= FAN:
                break
        #: The root above each row.
        self.root = np.arange(len(group))
        for _, _, _, children in reversed(self.levels[1:]):
            self.root = np.repeat(self.root, children)

    def near(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, later row) within the radius, for rows lo to hi."""
        query, node = np.arange(lo, hi), self.root[lo:hi]
        above, pattern, *_ = self.levels[-1]
        apart = self._apart(query, node, pattern, above[node])
        keep = apart <= self.radius
        query, node, apart = query[keep], node[keep], apart[keep]
        for level in range(len(self.levels) - 1, 0, -1):
            above, _, first, children = self.levels[level]
            mask, pattern, *_ = self.levels[level - 1]
            n = children[node]
            if n.sum() * self.fp.shape[1] > FRONTIER and hi - lo > 1:
                middle = (lo + hi) // 2
                yield from self.near(lo, middle)
                yield from self.near(middle, hi)
                return
            child = np.repeat(first[node], n) + _spread(n)
            query, apart, up = np.repeat(query, n), np.repeat(apart, n), np.repeat(node, n)
            apart = apart + self._apart(query, child, pattern, mask[child] & ~above[up])
            keep = apart <= self.radius
            query, node, apart = query[keep], child[keep], apart[keep]
        later = node > query
        yield query[later], node[later]

    def _apart(self, query: np.ndarray, node: np.ndarray, pattern: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.bitwise_count((self.fp[query] ^ pattern[node]) & mask).sum(axis=1, dtype=np.int64)

    def forest(self) -> np.ndarray:
        """For each row in the order given, a row of its component: the same one for all of them."""
        label = np.arange(len(self.fp))
        for lo in range(0, len(label), 20_000):
            for a, b in self.near(lo, min(lo + 20_000, len(label))):
                while len(a):
                    x, y = label[a], label[b]
                    open_ = x != y
                    a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                    if len(a):
                        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                        while (label != (up := label[label])).any():
                            label = up
        out = np.empty_like(label)
        out[self.order] = self.order[label]
        return out


def _words(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), ">u8").astype(np.uint64).reshape(len(prints), -1)


def _links(radius: int):
    def solve(key: np.ndarray, v: np.ndarray, prints: list[bytes]) -> pa.RecordBatch:
        root = GrayIndex(key, _words(prints), radius).forest()
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(v[moved]), pa.array(v[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows (key, v, fp) in key order: links (a, b) that join what is near within each key."""
        key, v, prints = np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            key, v = np.r_[key, batch.column("key").to_numpy()], np.r_[v, batch.column("v").to_numpy()]
            prints += batch.column("fp").to_pylist()
            if len(key) >= INDEX_ROWS and (whole := int(np.searchsorted(key, key[-1]))):  # the last group may go on
                yield solve(key[:whole], v[:whole], prints[:whole])
                key, v, prints = key[whole:], v[whole:], prints[whole:]
        if prints:
            yield solve(key, v, prints)

    return run


def _bands(bits: int, bands: int):
    place = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                prints = part.column("fp").to_pylist()
                all_ = np.unpackbits(_words(prints).astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)
                key = all_[:, : bands * bits].reshape(-1, bands, bits) @ place + (np.arange(bands) << bits)
                row = pa.array(np.repeat(np.arange(len(prints)), bands))
                compared = pa.array([x[: 8 * NEAR_LANES] for x in prints], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column("v").take(row), compared.take(row)], names=["key", "v", "fp"])

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, bands: tuple[int, int] | None = None) -> DataFrame:
    """Links (a, b) of vertices (v, fp): their components are those of all candidate links within the radius.

    Without ``bands`` (bits of one, how many) the fingerprints have 64 bits and no link is missed.
    """
    if bands:
        groups = nodes.select("v", "fp").mapInArrow(_bands(*bands), "key long, v long, fp binary")
    else:
        blocks = radius + 1
        wide = 64 // blocks
        sub = wide // blocks  # a block's other bits, in blocks of so many bits of each other block
        part = lambda i, width: F.shiftrightunsigned("v", i * width).bitwiseAND((1 << width) - 1)
        rows = nodes.select("v", "fp", F.explode(F.array(*[part(i, wide) + F.lit(i << wide) for i in range(blocks)])).alias("key"))
        counted = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
        again = [F.xxhash64(F.lit(j), "key", *[F.shiftrightunsigned("v", i * wide + j * sub).bitwiseAND((1 << sub) - 1) for i in range(blocks)]) for j in range(blocks)]
        deep = counted.where(F.col("n") > GROUP_ROWS).select(F.explode(F.array(*again)).alias("key"), "v", "fp")
        groups = counted.where(F.col("n") <= GROUP_ROWS).select("key", "v", "fp").unionByName(deep)
    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long")


def components(links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """v, label: one vertex of each component for all its vertices with links (a, b), by contraction.

    Each round takes every vertex to the smallest of itself and its neighbours and keeps the links
    between different ones. A star or a dense group is gone after a round; the rounds then resolve
    backwards.
    """
    edge = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    open_ = scratch.put(links.select(*edge("a", "b")).where("a < b").distinct(), "links-0")
    rounds: list[DataFrame] = []
    while not open_.isEmpty():
        n = len(rounds)
        ends = open_.select("a", F.explode(F.array("a", "b")).alias("v"))
        labels = scratch.put(ends.groupBy("v").agg(F.min("a").alias("label")), f"labels-{n}")
        half = open_.join(labels.select(F.col("v").alias("a"), F.col("label").alias("x")), "a").select("x", "b")
        whole = half.join(labels.select(F.col("v").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        open_ = scratch.put(whole.select(*edge("x", "y")).distinct(), f"links-{n + 1}")
        rounds.append(labels)
    if not rounds:
        return links.select(F.col("a").alias("v"), F.col("b").alias("label")).limit(0)
    out = rounds.pop()
    while rounds:
        later = out.select(F.col("v").alias("label"), F.col("label").alias("up"))
        out = rounds.pop().join(later, "label", "left").select("v", F.coalesce("up", "label").alias("label"))
    return scratch.put(out, "components")


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, exact: bool = False) -> DataFrame:
    """doc_id, text_hash, fp, component_id, and stays: whether it is its component's first document.

    With ``exact``, 64-bit fingerprints linked at ``RADIUS``; else the wide ones, for similarity 0.8.
    """
    bits, n_bands, lanes = (0, 0, 1) if exact else bands_for(docs.count())
    scratch = common.Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(doc).alias("doc_id"), common.as_text(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = scratch.put(rows.mapInArrow(common.small(_prints(words, lanes)), f"doc_id {kind}, text_hash long, v long, fp binary"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("first")
    nodes = scratch.put(prints.groupBy("v").agg(first, F.min("fp").alias("fp")), "nodes")
    labels = components(scratch.put(near_links(nodes, *((RADIUS, None) if exact else (NEAR_RADIUS, (bits, n_bands)))), "found"), scratch)
    named = scratch.put(nodes.select("v", "first").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")), "named")
    # a table of its own, so that Spark can split the rows of a large component in the join
    firsts = scratch.put(named.groupBy("label").agg(F.min("first").alias("head")), "firsts")
    heads = scratch.put(named.select("v", "label").join(firsts, "label").select("v", "head"), "heads")
    mine = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")
    return prints.join(heads, "v").select("doc_id", "text_hash", "fp", F.col("head.doc_id").alias("component_id"), (mine == F.col("head")).alias("stays"))


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = NEAR_WORDS) -> DataFrame:
    """The first document of each component of near-duplicates, with all columns."""
    own, digest = common.unused(docs, "stay_id"), common.unused(docs, "stay_hash")
    stays = classes(docs, doc, text, words).where("stays").select(F.col("doc_id").alias(own), F.col("text_hash").alias(digest)).distinct()
    on = common.column(doc).eqNullSafe(F.col(own)) & (F.xxhash64(common.as_text(text)) == F.col(digest))
    return docs.join(stays, on, "left_semi").select(*[common.column(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.documents(spark, sf_dir), words=WORDS, exact=True)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
