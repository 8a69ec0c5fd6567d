"""Benchmark decontamination by latent semantic retrieval.

1. The vocabulary is the benchmark's words. Texts are turned into word numbers once; the words' passage frequencies are counted over all documents.
2. A randomised SVD of the TF-IDF passages is computed in Spark: partitions multiply their part of
   the matrix with the sketch, tasks by slice of words add up the parts, the driver orthogonalises the
   sums. It covers every passage of every document, and all items.
3. An item is compared with windows of its own length: with blocks of g words, g the power of two of which
   the item has over two and at most four (1 up to ``EVERY`` words), windows of as many blocks as hold the item begin at every
   block. An item whose cosine with a window reaches ``LEAST_COSINE`` is a candidate of the document.
   So is an item of which ``SEED`` words in a row (two in an item below ``SHORT`` words; all, if it has fewer), one of the rarer
   half of its runs, stand in the document, when the item's whole length of words there reaches that cosine in all words
   instead of the space: an item as it is written is always a candidate, however frequent its words, however often it is
   copied and however long it is.
4. A candidate is a leak when the longest common subsequence of the item and the words around the
   window covers ``LEAST_LCS`` of the item, and the answer check finds ``LEAST_ANSWER`` of the rarer
   half of the item's words there. Both survive replaced, dropped and inserted words.

The benchmark goes through in blocks of ``ITEM_BLOCK`` items, so what a task holds has a bound.

Defined cases: null texts are empty and match nothing; items without words are never found; an
item of one word is found wherever that word is; an item that occurs twice in a document is one row, with its best place; repeated rows of the benchmark are
one item, repeated documents have their own rows; a null item id is an id like others; very long texts are cut in blocks like
all; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import common

ITEM_BLOCK = 4096
#: Slices of words that partial sums are added in; bytes of word numbers that the search, and a product, work on at once.
SLICES, SLAB, PRODUCT_SLAB = 16, 64 << 10, 256 << 10
BLOCK, RANK, OVERSAMPLE, ROUNDS = 24, 64, 16, 1
#: The rank is RANK, and grows to one for so many items of a block.
RANK_ITEMS = 16
LEAST_COSINE, LEAST_LCS, LEAST_ANSWER = 0.6, 0.6, 0.5
#: Words in a row that make an item a candidate, two in items below SHORT words; runs of an item that are looked for, half
#: of them or more; items up to EVERY words have windows at each word; the weight of a word that every passage holds; words that a step gathers.
SEED, SHORT, LEAST_RUNS, EVERY, LEAST_IDF, GATHER = 3, 16, 4, 8, 0.05, 1 << 18
_WORD = re.compile(r"\w+")
#: The same for texts of one byte a character: all but letters, digits and underscores are blanks.
_BLANKED = bytes(i if chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256))


def words(text: str) -> list[str]:
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_BLANKED).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


@dataclass
class Items:
    """A block of the benchmark in vocabulary numbers."""

    ids: list
    lists: list[np.ndarray]
    vocabulary: dict[str, int]


def read_items(rows: list[tuple]) -> Items:
    vocabulary: dict[str, int] = {}
    ids, lists = [], []
    for own, text in rows:
        numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        if numbers:
            ids.append(own)
            lists.append(np.array(numbers, np.int64))
    return Items(ids, lists, vocabulary)


def _kind(vocabulary: dict[str, int]) -> np.dtype:
    return np.dtype("<u2" if len(vocabulary) < 0xFFFF else "<u4")


def _number(vocabulary: dict[str, int]):
    """Each text as the numbers of its words; the type's largest number is an unknown word."""
    kind = _kind(vocabulary)
    unknown, get = int(np.iinfo(kind).max), vocabulary.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in common.chunks(b, "text", 1 << 20)):
            data = [np.array([get(w, unknown) for w in words(t)], kind).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(data, pa.binary())], names=["doc_id", "text_hash", "numbers"])

    return run


def _blocks(column: pa.Array, kind: np.dtype, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: each word's number (-1 if unknown), its block, each text's first block and first word."""
    data = column.to_pylist()
    sizes = np.fromiter(map(len, data), np.int64, len(data)) // kind.itemsize
    first = np.r_[0, (-(-sizes // size)).cumsum()]
    start = np.r_[0, sizes.cumsum()]
    number = np.frombuffer(b"".join(data), kind).astype(np.int64)
    number[number == np.iinfo(kind).max] = -1
    block = np.repeat(first[:-1], sizes) + (np.arange(start[-1]) - np.repeat(start[:-1], sizes)) // size
    return number, block, first, start


def _frequencies(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = 0, len(vocabulary)
        seen = np.zeros(v, np.int64)
        for part in (x for b in batches for x in common.chunks(b, "numbers", 512 << 10)):
            number, block, first, _ = _blocks(part.column("numbers"), _kind(vocabulary))
            n += int(first[-1])
            known = number >= 0
            pairs = np.sort(block[known] * v + number[known])
            if len(pairs):
                seen += np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] % v, minlength=v)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[n, seen[some]].astype(np.int64))], names=["word", "n"])

    return run


def _passages(number: np.ndarray, block: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The sum of the words' rows of ``table`` in each of ``n`` blocks."""
    out = np.zeros((n, table.shape[1]), table.dtype)
    known = np.flatnonzero(number >= 0)
    if len(known):
        own, word = block[known], number[known]
        place = _within(np.bincount(own, minlength=n))
        order = np.argsort(place, kind="stable")  # the first known word of every block, then the second, ..
        ends = np.cumsum(np.bincount(place))
        for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            some = order[lo:hi]
            out[own[some]] += table[word[some]]
    return out


def _windows(blocks: np.ndarray, first: np.ndarray, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """By ``wanted`` numbers n in order: each block with the ``n - 1`` next of its text, or as many as there are."""
    out, have = blocks.copy(), 1
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(blocks))
    for n in wanted:
        for i in range(have, min(n, len(blocks))):
            after = blocks[i:].copy()
            after[np.flatnonzero(left[:-i] <= i)] = 0
            out[:-i] += after
        have = n
        yield n, out


def _doubled(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of twice as many words, and each text's first."""
    sizes = np.diff(first)
    place = np.arange(len(blocks)) - np.repeat(first[:-1], sizes)
    out = blocks[place % 2 == 0]
    odd = np.flatnonzero(place % 2)
    out[(np.cumsum(place % 2 == 0) - 1)[odd]] += blocks[odd]
    return out, np.r_[0, (-(-sizes // 2)).cumsum()]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _gram_product(vocabulary: dict[str, int], idf: np.ndarray, q: np.ndarray):
    """Partial sums of A' (A q) over the rows of A: TF-IDF passages scaled to unit length. A row for each slice of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(vocabulary)
        total, table, light = np.zeros(q.T.shape), np.ascontiguousarray((q * idf[:, None]).T, np.float32), idf.astype(np.float32)
        for batch in batches:
            for part in common.chunks(batch, "numbers", PRODUCT_SLAB):
                number, block, first, _ = _blocks(part.column("numbers"), _kind(vocabulary))
                known = number >= 0
                number, block = number[known], block[known]
                if not len(number):
                    continue
                # entries in order of passages for A q, in order of words for A' (A q)
                begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                passage = np.cumsum(np.r_[False, block[1:] != block[:-1]])
                scale = 1 / np.add.reduceat(light[number] ** 2, begin)
                order = np.argsort(number.astype(kind), kind="stable")
                sorted_, passage = number[order], passage[order]
                ends = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                weight, word = light[sorted_], sorted_[ends]
                for j in range(0, len(table), 8):
                    image = np.add.reduceat(table[j : j + 8].take(number, axis=1), begin, axis=1) * scale
                    total[j : j + 8, word] += np.add.reduceat(image.take(passage, axis=1) * weight, ends, axis=1)
        some = np.flatnonzero(total.any(axis=0))
        cut = [some[some % SLICES == i] for i in range(SLICES)]
        rows = [total[:, x].T.astype(np.float32).tobytes() for x in cut]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.astype(np.int32).tobytes() for x in cut], pa.binary()), pa.array(rows, pa.binary())], names=["slice", "words", "part"])

    return run


def _add_parts(width: int, n: int):
    """The sum of all parts of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, words_, part in zip(*(batch.column(c).to_pylist() for c in ("slice", "words", "part")), strict=True):
                own = sums.setdefault(i, np.zeros((-(-n // SLICES), width)))
                own[np.frombuffer(words_, np.int32) // SLICES] += np.frombuffer(part, np.float32).reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "sums"])

    return run


def latent(texts: DataFrame, items: Items, idf: np.ndarray, scratch: common.Scratch, seed: int = 3) -> np.ndarray:
    """Words x rank: the right singular vectors of all TF-IDF passages, by randomised subspace iteration."""
    v = len(items.vocabulary)
    rank = max(RANK, -(-len(items.lists) // RANK_ITEMS))
    q = np.random.default_rng(seed).standard_normal((v, min(v, rank + OVERSAMPLE)))
    sizes = np.array([len(x) for x in items.lists])
    # a row of the matrix for each item, as entries (row, word, weight)
    entry, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * v + np.concatenate(items.lists), return_counts=True)
    row, word = entry // v, entry % v
    weight = count * idf[word]
    weight /= np.sqrt(np.bincount(row, weight**2))[row]
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])

    def product(q: np.ndarray, name: str) -> np.ndarray:
        parts = texts.mapInArrow(_gram_product(items.vocabulary, idf, q), "slice int, words binary, part binary")
        added = scratch.put(parts.repartition("slice").mapInArrow(_add_parts(q.shape[1], v), "slice int, sums binary"), name)
        total = np.zeros_like(q)
        for r in added.collect():  # one row a slice: as many numbers as q has
            total[r["slice"] :: SLICES] = np.frombuffer(r["sums"]).reshape(-1, q.shape[1])[: len(range(r["slice"], v, SLICES))]
        scratch.drop(name)
        # the items weigh as much as the passages, so that what they are about has a place in the space
        image = np.add.reduceat(q[word] * weight[:, None], begins, axis=0)
        theirs = np.zeros_like(q)
        np.add.at(theirs, word, image[row] * weight[:, None])
        return theirs + total * (np.linalg.norm(theirs) / max(np.linalg.norm(total), 1e-12) if total.any() else 0.0)

    for i in range(ROUNDS):
        q, _ = np.linalg.qr(product(q, f"round-{i}"))
    image = product(q, "last")
    # Nystrom: the space of this product, one round beyond that of q
    within = q.T @ image
    values, turn = np.linalg.eigh((within + within.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-30)
    return np.linalg.svd(image @ (turn[:, keep] / np.sqrt(values[keep])), full_matrices=False)[0][:, :rank]


def lcs(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Longest common subsequence with an item given as bit masks of its words, bit-parallel."""
    full = (1 << size) - 1
    row = full
    for x in other:
        if m := masks.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


class Seeds:
    """Where the items' runs of ``SEED`` words are in texts, and how like the item the words there are."""

    def __init__(self, items: Items, idf: np.ndarray) -> None:
        self.v, self.weight = len(items.vocabulary) + 1, idf * idf
        self.size = np.array([len(x) for x in items.lists])
        #: By length of the run: its words as one number, sorted, with item and offset.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        length = np.minimum(self.size, np.where(self.size < SHORT, SEED - 1, SEED))
        for n in sorted(set(length.tolist())):
            own = np.flatnonzero(length == n)
            offsets = [self._rare(idf[items.lists[i]], n) for i in own]
            key = np.concatenate([self._key(items.lists[i], n)[x] for i, x in zip(own, offsets, strict=True)])
            item = np.repeat(own, [len(x) for x in offsets])
            order = np.argsort(key, kind="stable")
            self.runs[n] = key[order], item[order], np.concatenate(offsets)[order]
        self.word, count = np.unique(np.concatenate([i * self.v + x for i, x in enumerate(items.lists)]), return_counts=True)
        self.count = count.astype(float)
        self.norm = np.sqrt(np.bincount(self.word // self.v, self.count**2 * self.weight[self.word % self.v]))

    @staticmethod
    def _rare(weight: np.ndarray, n: int) -> np.ndarray:
        """Where the rarer half of an item's runs begin, at least ``LEAST_RUNS`` of them."""
        weight = np.convolve(weight, np.ones(n), "valid")
        return np.sort(np.argsort(-weight, kind="stable")[: max(LEAST_RUNS, -(-len(weight) // 2))])

    def _key(self, number: np.ndarray, n: int) -> np.ndarray:
        """``n`` words from each place on as one number; less than 0 with an unknown word."""
        out, known = np.zeros(max(0, len(number) - n + 1), np.int64), True
        for i in range(n):
            x = number[i : len(number) - n + 1 + i]
            out, known = out * self.v + x, known & (x >= 0)
        return np.where(known, out, -1)

    def find(self, number: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Item, text, first and end word of places that reach ``LEAST_COSINE``, and that cosine."""
        for n, (key, item, offset) in self.runs.items():
            runs = self._key(number, n)
            low = np.searchsorted(key, runs)
            place = np.flatnonzero((runs >= 0) & (key[np.minimum(low, len(key) - 1)] == runs))
            text = np.searchsorted(start, place, "right") - 1
            inside = place + n <= start[text + 1]
            place, text = place[inside], text[inside]
            low = low[place]
            many = np.searchsorted(key, runs[place], "right") - low
            step = GATHER // int(self.size.max()) + 1
            ends = many.cumsum()
            at = 0
            while at < len(place):  # so many candidates at once, or those of one place
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
                which = np.repeat(low[at:to], many[at:to]) + _within(many[at:to])
                doc, begin = np.repeat(text[at:to], many[at:to]), np.repeat(place[at:to], many[at:to]) - offset[which]
                places = np.unique(np.stack([item[which], doc, begin]), axis=1)
                yield self._near(number, start, *places)
                at = to

    def _near(self, number: np.ndarray, start: np.ndarray, item: np.ndarray, text: np.ndarray, begin: np.ndarray) -> tuple:
        end = np.minimum(begin + self.size[item], start[text + 1])
        begin = np.maximum(begin, start[text])
        own = np.repeat(np.arange(len(item)), end - begin)
        word = number[np.repeat(begin, end - begin) + _within(end - begin)]
        own, word = own[word >= 0], word[word >= 0]
        pair, count = np.unique(own * self.v + word, return_counts=True)
        own, word = pair // self.v, pair % self.v
        theirs = item[own] * self.v + word
        at = np.minimum(np.searchsorted(self.word, theirs), len(self.word) - 1)
        weight = self.weight[word] * count
        dot = np.bincount(own, weight * self.count[at] * (self.word[at] == theirs), len(item))
        cosine = dot / (np.sqrt(np.bincount(own, weight * count, len(item))) * self.norm[item])
        keep = cosine >= LEAST_COSINE
        return item[keep], text[keep], begin[keep], end[keep], np.minimum(cosine[keep], 1.0)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each count."""
    ends = counts.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _best_of_neighbours(place: np.ndarray, which: np.ndarray, cosine: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of up to ``k`` candidates of one item and text at places in a row, the first with the highest cosine.

    What is looked at around it, an item's length either way, holds the windows of all of them.
    """
    order = np.lexsort((place, which))
    place, which, cosine = place[order], which[order], cosine[order]
    if not len(place):
        return place, which, cosine
    new = np.r_[True, (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1) | (text[place[1:]] != text[place[:-1]])]
    run = np.flatnonzero(new)
    within = _within(np.diff(np.r_[run, len(place)]))
    group = np.cumsum(new | (within % k == 0))
    best = np.lexsort((-cosine, group))
    best = np.sort(best[np.r_[True, np.diff(group[best]) > 0]])
    return place[best], which[best], cosine[best]


def _search(items: Items, idf: np.ndarray, space: np.ndarray, whole_ids: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    table = (space * idf[:, None]).astype(np.float32)
    wanted = _unit(np.stack([table[x].sum(axis=0) for x in items.lists])).astype(np.float32)
    masks: list[dict[int, int]] = []
    answers: list[set[int]] = []
    for numbers in items.lists:
        own: dict[int, int] = {}
        for i, x in enumerate(numbers.tolist()):
            own[x] = own.get(x, 0) | 1 << i
        masks.append(own)
        rare = sorted(own, key=lambda x: (-idf[x], x))
        answers.append(set(rare[: max(3, math.ceil(len(rare) / 2))]))
    sizes = [len(x) for x in items.lists]
    seeds = Seeds(items, idf)
    #: Items by words of a block and blocks of a window.
    classes: dict[int, dict[int, np.ndarray]] = {}
    for i, m in enumerate(sizes):
        g = 1 << math.ceil(math.log2(m / 4)) if m > EVERY else 1
        classes.setdefault(g, {}).setdefault(-(-m // g), []).append(i)
    classes = {g: {k: np.array(x) for k, x in sorted(own.items())} for g, own in sorted(classes.items())}
    finest = min(classes)

    def judge(item: int, near: list[int]) -> tuple[float, float]:
        have = answers[item].intersection(near)
        answer = len(have) / len(answers[item])
        return (lcs(masks[item], sizes[item], near) / sizes[item], answer) if answer >= LEAST_ANSWER else (0.0, answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in common.chunks(b, "numbers", SLAB)):
            number, block, first, start = _blocks(part.column("numbers"), _kind(items.vocabulary), finest)
            sums, size = _passages(number, block, int(first[-1]), table), finest
            found: dict[tuple[int, int], tuple] = {}

            def look(item: int, doc: int, begin: int, end: int, cosine: float) -> None:
                """The item against the words from ``begin`` to ``end`` and its length around them."""
                if (doc, item) in found and found[doc, item][:2] == (1.0, 1.0):
                    return
                low, high = int(start[doc]), int(start[doc + 1])
                a, b = max(low, begin - sizes[item]), min(high, end + sizes[item])
                common_, answer = judge(item, number[a:b].tolist())
                if common_ >= LEAST_LCS:
                    entry = (common_, answer, cosine, a - low, b - low)
                    if (doc, item) not in found or entry[:3] > found[doc, item][:3]:
                        found[doc, item] = entry

            for which, doc, a, b, cosine in seeds.find(number, start):
                order = np.argsort(-cosine, kind="stable")
                for place in zip(*(x[order].tolist() for x in (which, doc, a, b, cosine)), strict=True):
                    look(*place)
            for g, own in classes.items():
                while size < g:
                    (sums, first), size = _doubled(sums, first), 2 * size
                text = np.repeat(np.arange(len(start) - 1), np.diff(first))
                begin = start[text] + (np.arange(len(text)) - first[text]) * g
                for k, sums_k in _windows(sums, first, list(own)):
                    members = own[k]
                    norm, theirs = np.maximum(np.sqrt(np.einsum("ij,ij->i", sums_k, sums_k)), 1e-12)[:, None], wanted[members].T
                    for lo in range(0, len(sums_k), 8192):
                        cosine = sums_k[lo : lo + 8192] @ theirs
                        cosine /= norm[lo : lo + 8192]
                        place, which = np.nonzero(cosine >= LEAST_COSINE)
                        place, which, near = _best_of_neighbours(place, which, cosine[place, which], text[lo:], k)
                        at = begin[lo + place]
                        for x in zip(members[which].tolist(), text[lo + place].tolist(), at.tolist(), (at + k * g).tolist(), near.tolist(), strict=True):
                            look(*x)
            keys = sorted(found)
            values = [found[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())), part.column("text_hash").take(pa.array([k[0] for k in keys], pa.int64())), pa.array([items.ids[k[1]] for k in keys], pa.int64() if whole_ids else pa.string()),
                 *(pa.array([x[i] for x in values], pa.float64()) for i in range(3)), *(pa.array([x[i] for x in values], pa.int64()) for i in (3, 4))],
                names=["doc_id", "text_hash", "item_id", "lcs", "answer", "cosine", "first_word", "end_word"],
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each leaked item of a document: doc_id, text_hash, item_id, lcs, answer, cosine, first_word, end_word."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc_id"), common.as_text(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kinds = {"doc_id": rows.schema["doc_id"].dataType.simpleString(), "item_id": benchmark.schema[item].dataType.simpleString()}
    kinds["item_id"] = "bigint" if kinds["item_id"] in ("tinyint", "smallint", "int", "bigint") else "string"
    shape = f"doc_id {kinds['doc_id']}, text_hash bigint, item_id {kinds['item_id']}, lcs double, answer double, cosine double, first_word bigint, end_word bigint"
    asked = benchmark.select(F.col(item).cast(kinds["item_id"]).alias("item_id"), common.as_text(item_text).alias("text")).distinct()
    blocks = -(-asked.count() // ITEM_BLOCK)
    scratch = common.Scratch(spark, "decontam")
    numbered = f"doc_id {kinds['doc_id']}, text_hash bigint, numbers binary"
    found: list[str] = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64(F.lit(13), "item_id", "text"), F.lit(blocks)) == b)
        items = read_items(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, repr(x))))
        if not items.ids:
            continue
        words_ = scratch.put(rows.mapInArrow(_number(items.vocabulary), numbered), f"words-{b}")
        counts = {r["word"]: r["n"] for r in words_.select("numbers").mapInArrow(_frequencies(items.vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        seen = np.array([counts.get(i, 0) for i in range(len(items.vocabulary))], float)
        idf = np.log((1 + counts.get(-1, 0)) / (1 + seen)) + LEAST_IDF
        space = latent(words_.select("numbers"), items, idf, scratch)
        scratch.put(words_.mapInArrow(_search(items, idf, space, kinds["item_id"] == "bigint"), shape), f"found-{b}")
        scratch.drop(f"words-{b}")
        found.append(f"{scratch.path}/found-{b}")
    return spark.read.schema(shape).parquet(*found) if found else spark.createDataFrame([], shape)


def clean(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns."""
    own, digest = common.unused(docs, "bad_id"), common.unused(docs, "bad_hash")
    bad = leaks(docs, benchmark, doc, text).select(F.col("doc_id").alias(own), F.col("text_hash").alias(digest)).distinct()
    on = common.column(doc).eqNullSafe(F.col(own)) & (F.xxhash64(common.as_text(text)) == F.col(digest))
    return docs.join(common.Scratch(docs.sparkSession, "leaks").put(bad, "bad"), on, "left_anti").select(*[common.column(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark")).drop("text_hash")
