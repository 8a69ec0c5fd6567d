"""Language identification as multilingual mixture inference.

A document is a mixture of languages. Each letter with its neighbours (a word's edge is a blank) is
a trigram, hashed to ``GRAMS`` values; a language gives each trigram a probability learned from
labelled texts. Expectation maximisation estimates the proportions that explain the document's
trigrams best. Languages enter the document's set by falling proportion while the log-likelihood,
refitted within the set, gains more than ``PENALTY * ln(trigrams)``. The prediction is the language
with the largest proportion of the chosen set, the score is that proportion.

Learning takes all rows of a language, or a seeded sample of about ``SAMPLE_ROWS`` of them, whole
texts each; counts are summed in Spark, so the driver gets at most ``GRAMS`` numbers a language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing could be learned; rows with a null language teach nothing; equal proportions go to the
language first in code-point order; repeated rows are rows of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm import common

GRAMS = 1 << 16
SAMPLE_ROWS = 2500
#: The part of a language's probability that is spread over all trigrams.
FLOOR = 0.02
PENALTY = 1.0
_STEPS, _NEAR = 24, 2e-3
_letters: np.ndarray | None = None


def trigrams(text: str) -> np.ndarray:
    """The hashed trigrams around each letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    here = _letters[code]
    code = np.where(here, code, np.uint32(0))
    at = np.flatnonzero(here)
    mixed = code[at - 1] * np.uint32(0x9E3779B1) ^ code[at] * np.uint32(0x85EBCA77) ^ (code[at + 1] + np.uint32(7)) * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tally: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tally.setdefault(lang, np.zeros(GRAMS, np.int64))
            tally[lang] += np.bincount(trigrams(text), minlength=GRAMS)
        for lang, n in tally.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and the probability of each trigram in each."""
    rows = labelled.select(F.col(doc).alias("doc_id"), common.as_text(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, GRAMS), np.float64)
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, math.ceil(1e6 * sample_rows / n)))])
    some = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < limit[F.col("lang")])
    counts = some.select("lang", "text").mapInArrow(common.small(_count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(x for x in sizes if (counts["lang"] == x).any())
    table = np.zeros((len(langs), GRAMS))
    for i, name in enumerate(langs):
        own = counts[counts["lang"] == name]
        table[i, own["gram"].to_numpy()] = own["n"].to_numpy()
        table[i] /= table[i].sum()
    return langs, (1 - FLOOR) * table + FLOOR / GRAMS


def _fit(p: np.ndarray, n: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions by expectation maximisation, and the log-likelihood."""
    share, total = start, n.sum()
    for _ in range(steps):
        new = share * (p @ (n / (share @ p))) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < _NEAR:
            break
    return share, float(n @ np.log(share @ p))


def proportions(grams: np.ndarray, table: np.ndarray) -> list[tuple[int, float]]:
    """The chosen languages of one document with their proportions, largest first."""
    n = np.bincount(grams, minlength=GRAMS)
    some = np.flatnonzero(n)
    n, p = n[some].astype(float), np.ascontiguousarray(table[:, some])
    k = len(table)
    share, _ = _fit(p, n, np.full(k, 1 / k), _STEPS)
    order = np.argsort(-share, kind="stable")
    cost = PENALTY * math.log(len(grams) + 1)
    best, chosen = float(n @ np.log(p[order[0]])) - cost, [(int(order[0]), 1.0)]
    for size in range(2, k + 1):
        part = order[:size]
        start = share[part] + 1e-9
        own, likely = _fit(p[part], n, start / start.sum(), _STEPS // 2)
        if likely - cost * size <= best:
            break
        best, chosen = likely - cost * size, sorted(((int(a), float(b)) for a, b in zip(part, own, strict=True)), key=lambda x: (-x[1], x[0]))
    return chosen


def _predictor(langs: list[str], table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, mixes = [], [], []
            for text in batch.column("text").to_pylist():
                grams = trigrams(text)
                mix = proportions(grams, table) if len(grams) and langs else []
                names.append(langs[mix[0][0]] if mix else "und")
                scores.append(min(1.0, max(0.0, mix[0][1])) if mix else 0.0)
                mixes.append([{"lang": langs[i], "share": x} for i, x in mix])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """doc_id, held_out (``mark``), lang_pred, score, languages (array of lang and share)."""
    rows = docs.select(F.col(doc).alias("doc_id"), (F.lit(False) if mark is None else mark).alias("held_out"), common.as_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(common.small(_predictor(*model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = learn(docs.where(~common.held_out(F.col("doc_id"))))
    return identify(docs, model, mark=common.held_out(F.col("doc_id")))
