"""Toxicity by weak supervision.

1. Voters are patterns that speak for toxicity: a built-in lexicon, style patterns, and the words and
   word beginnings (in one word, or in several) that toxic labelled texts hold far more often than others.
2. A generative model of the votes estimates, by expectation maximisation, how often each voter fires
   on either class. The given labels are one more voter, whose errors are estimated too. Voters that
   are correlated within a class share one vote: a voter's weight is one over the sum of its squared
   correlations with all voters.
3. The posterior labels train a logistic regression on the voters and their number, fitted to the
   classes' natural frequencies. Documents get its probability; 0.3 or more is toxic.

Learning takes a seeded sample of about ``SAMPLE_ROWS`` toxic rows and ``CLEAN_TIMES`` as many others,
whole texts each (all rows if there are fewer); the driver gets the sample's votes and at most ``MAX_VOTERS`` voters.

Defined cases: a null text is empty and has a score; null labels teach nothing; an id with several
labels is toxic if one of them says so, and one with several rows teaches by its smallest text; without labels the lexicon's prior accuracies decide; repeated
rows are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm import common

SAMPLE_ROWS, CLEAN_TIMES, MAX_VOTERS = 4000, 3, 384
#: A mined voter needs this log-likelihood ratio against independence, as millions of patterns are tried.
LEAST_LLR = 45.0
#: The same over distinct words, for beginnings that few toxic texts have, but each of them in many words.
LEAST_WORD_LLR = 50.0
THRESHOLD = 0.3
#: Patterns that a task counts before it hands them on.
TALLIED = 150_000
#: Insults that vote before anything is learned.
LEXICON = ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumbass", "scum", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "garbage", "clown", "freak", "vermin", "bastard", "bitch", "asshole", "retard", "whore", "slut", "shut up", "kill yourself")
_STYLE = {"~bangs": re.compile(r"!!"), "~masked": re.compile(r"[^\W\d_][*#@$]{2,}[^\W\d_]"), "~shout": re.compile(r"(?:\b[A-Z]{3,}\b[^\w]+){3}")}
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6)


def _patterns(words: set[str]) -> Iterator[tuple[str, int]]:
    """Patterns and the words that they are in."""
    for w in words:
        if len(w) >= 3:
            yield "=" + w, 1
    for k in _PREFIXES:
        for w, n in Counter(w[:k] for w in words if len(w) > k).items():
            yield "^" + w, n
            if n > 1:
                yield "%" + w, n


def _mine(wanted: set[str] | None):
    """pattern, texts, words: texts that hold a pattern and the distinct words that do; all words as ``#``.

    With ``wanted``, these patterns only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, inside = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = ["#", *texts]
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (texts, inside))], names=["pattern", "texts", "words"])
            texts.clear()
            inside.clear()
            return made

        for batch in batches:
            if len(texts) > TALLIED:
                yield out()
            for text in batch.column("text").to_pylist():
                words = set(_WORD.findall(text.lower()))
                inside["#"] += len(words)
                for pattern, n in _patterns(words):
                    if wanted is None or pattern in wanted:
                        texts[pattern] += 1
                        inside[pattern] += n
        yield out()

    return run


def _llr(on: float, off: float, share: float) -> float:
    """How far two counts are from a split by ``share``."""
    part = lambda n, of: n * math.log(n / of) if n else 0.0
    return 2 * (part(on, (on + off) * share) + part(off, (on + off) * (1 - share)))


def mine(sample: DataFrame, n1: int, n0: int) -> list[str]:
    """The patterns that speak for toxicity most, at most ``MAX_VOTERS``."""

    def counted(toxic: int, wanted: set[str] | None, least: float) -> dict[str, tuple[int, int]]:
        found = sample.where(F.col("toxic") == toxic).mapInArrow(common.small(_mine(wanted)), "pattern string, texts long, words long")
        found = found.groupBy("pattern").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words"))
        return {r["pattern"]: (r["texts"], r["words"]) for r in found.where((F.col("texts") >= least) | (F.col("pattern") == "#")).collect()}

    on = counted(1, None, max(3, 0.004 * n1))
    off = counted(0, set(on), 1)
    w1, w0 = on.get("#", (0, 0))[1], off.get("#", (0, 0))[1]
    gains = []
    for pattern, (texts, words) in on.items():
        t0, w = off.get(pattern, (0, 0))
        strong = _llr(texts, t0, (n1 + 0.5) / (n0 + n1 + 1)) >= LEAST_LLR or _llr(words, w, (w1 + 0.5) / (w0 + w1 + 1)) >= LEAST_WORD_LLR
        gain = texts / max(n1, 1) - 4 * t0 / max(n0, 1)
        if pattern != "#" and strong and gain > 0 and texts / (n1 + 1) > 12 * t0 / (n0 + 1):
            gains.append((-gain, pattern))
    return [pattern for _, pattern in sorted(gains)[:MAX_VOTERS]]


@dataclass
class Voters:
    """Patterns by kind, and which of them a text holds."""

    names: list[str]
    lengths: tuple[int, ...] = field(init=False)
    place: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.place = {x: i for i, x in enumerate(self.names)}
        self.lengths = tuple(sorted({len(x) - 1 for x in self.names if x[0] in "^%"}))
        self.starts = {k: {x[1:] for x in self.names if x[0] in "^%" and len(x) == k + 1} for k in self.lengths}
        self.whole = {x[1:] for x in self.names if x[0] == "=" and " " not in x}
        self.phrases = [x[1:] for x in self.names if x[0] == "=" and " " in x]

    def of(self, text: str) -> list[int]:
        low = text.lower()
        words = set(_WORD.findall(low))
        found = [self.place["=" + x] for x in words & self.whole]
        for k in self.lengths:
            for x, n in Counter(w[:k] for w in words if len(w) > k and w[:k] in self.starts[k]).items():
                found += [self.place[y] for y in ("^" + x, "%" + x)[: min(n, 2)] if y in self.place]
        found += [self.place["=" + x] for x in self.phrases if x in low]
        return found + [self.place[k] for k, rx in _STYLE.items() if k in self.place and rx.search(text)]


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float
    #: For a report: how often each voter fires on toxic and on clean texts, and its weight in the label model.
    rates: np.ndarray

    def score(self, text: str) -> float:
        own = self.voters.of(text)
        z = self.bias + float(self.weights[own].sum()) + float(self.weights[-1]) * math.log1p(len(own))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def label_model(votes: np.ndarray, gold: np.ndarray, prior: float, first: np.ndarray | None = None, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Posterior labels of the rows, and (rate if toxic, rate if clean, weight) of each voter.

    ``votes`` is rows x voters in 0 and 1; ``gold`` holds 0, 1 or -1 for no label.
    """
    posterior = np.where(gold == 1, 0.97, np.where(gold == 0, 0.03, prior)) if first is None else first
    weight = np.ones(votes.shape[1])
    for _ in range(steps):
        mass, rest = posterior.sum(), (1 - posterior).sum()
        on = (posterior @ votes + 0.5) / (mass + 2)
        off = ((1 - posterior) @ votes + 0.5) / (rest + 2)
        # residual products without the residuals: V - q on' - (1 - q) off'
        q, r = posterior.astype(votes.dtype), (1 - posterior).astype(votes.dtype)
        vq, vr, qq, qr, rr = votes.T @ q, votes.T @ r, float(q @ q), float(q @ r), float(r @ r)
        together = (votes.T @ votes).astype(float) - np.outer(vq, on) - np.outer(on, vq) - np.outer(vr, off) - np.outer(off, vr)
        together += qq * np.outer(on, on) + rr * np.outer(off, off) + qr * (np.outer(on, off) + np.outer(off, on))
        together /= max(len(votes), 1)
        spread = np.sqrt(np.maximum(np.diag(together), 0)) + 1e-3
        together /= np.outer(spread, spread)
        weight = 1 / np.maximum(1, (together**2).sum(axis=1))
        # the label voter's errors, with a prior as heavy as the labels themselves: 0.97 and 0.01
        n1, n0 = (gold == 1).sum() + 1, (gold == 0).sum() + 1
        right = (posterior[gold == 1].sum() + 0.97 * n1) / (posterior[gold >= 0].sum() + n1)
        wrong = ((1 - posterior)[gold == 1].sum() + 0.01 * n0) / ((1 - posterior)[gold >= 0].sum() + n0)
        z = math.log(prior / (1 - prior)) + votes @ (weight * (np.log(on / off) - np.log((1 - on) / (1 - off)))) + (weight * np.log((1 - on) / (1 - off))).sum()
        z += np.where(gold == 1, math.log(right / wrong), np.where(gold == 0, math.log((1 - right) / (1 - wrong)), 0.0))
        posterior = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return posterior, np.stack([on, off, weight]) if steps else np.zeros((3, votes.shape[1]))


def _logistic(x: np.ndarray, y: np.ndarray, row_weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    row_weight, y = row_weight.astype(x.dtype), y.astype(x.dtype)
    w, pull = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30)))
        h = (x * (row_weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(h.astype(float), (x.T @ (row_weight * (y - p))).astype(float) - pull * w)
        w += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-4:
            break
    return w


def _vote(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([voters.of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["toxic", "votes"])

    return run


def learn(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from labelled documents; ``labels`` may be of any size."""
    marks = labels.select(F.col(doc).alias("_id"), F.col(toxic).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull())
    marks = marks.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {k: min(1.0, sample_rows * (1 if k else CLEAN_TIMES) / n) for k, n in sizes.items()}
    pick = F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, int(1e6 * rate.get(1, 1))).otherwise(int(1e6 * rate.get(0, 1)))
    scratch = common.Scratch(docs.sparkSession, "toxicity")
    rows = docs.select(F.col(doc).alias("_id"), common.as_text(text).alias("text"))
    # the labels of the sample: at most about (1 + CLEAN_TIMES) * sample_rows, whatever the input
    picked = rows.join(F.broadcast(marks.where(pick)), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = scratch.put(picked.select("text", "toxic"), "sample")
    own = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = own.get(1, 0), own.get(0, 0)
    names = list(dict.fromkeys([*mine(sample, n1, n0), *("=" + x for x in LEXICON), *_STYLE]))
    voters = Voters(names)
    cast = sample.mapInArrow(common.small(_vote(voters)), "toxic int, votes array<int>").collect()
    votes = np.zeros((len(cast) + 2, len(names)), np.float32)
    for i, r in enumerate(cast):
        votes[i, r["votes"]] = 1
    # two rows stand for what is known before: a toxic text of the lexicon, and a clean one
    votes[-2, [voters.place["=" + x] for x in LEXICON]] = 1
    gold = np.array([r["toxic"] for r in cast] + [1, 0])
    posterior, rates = label_model(votes, gold, (n1 + 1) / (n0 + n1 + 2))
    share = np.where(gold == 1, 1 / max(rate.get(1, 1), 1e-9), 1 / max(rate.get(0, 1), 1e-9))
    x = np.c_[votes, np.log1p(votes.sum(axis=1))].astype(np.float32)
    w = _logistic(x, posterior, share * len(share) / share.sum())
    return Model(voters, w[:-1], float(w[-1]), rates)


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column("_text").to_pylist()]
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "_score"])

    return run


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """doc_id, held_out (``mark``), score, predicted."""
    rows = docs.select(F.col(doc).alias("doc_id"), (F.lit(False) if mark is None else mark).alias("held_out"), common.as_text(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(common.small(_scorer(model), "_text"), f"doc_id {kind}, held_out boolean, _score double")
    return found.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    packed = docs.select(F.struct(*[common.column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"), common.as_text(text).alias("_text"))
    kept = packed.mapInArrow(common.small(_scorer(model), "_text"), common.extended(packed.select("_row"), "_score double")).where(F.col("_score") < THRESHOLD)
    return kept.select(*[F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    mark = common.held_out(F.col("doc_id"))
    labels = common.documents(spark, sf_dir, "labels").where(~mark)
    return score(docs, learn(docs.where(~mark), labels), mark=mark)
