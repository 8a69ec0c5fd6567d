"""Candidate sets from several channels: fusion by reciprocal rank, duplicates, coverage.

Channel hits are long: channel, qid, tid, score, rank (from 1). Rankings are qid, tid, rrf, rrf_rank.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera import session
from tessera.functions import text
from tessera.operators import blocking, lexical

# The channels' weights and depths.
CHANNEL_WEIGHTS = {"joint": 1.2, "address_only": 1.1, "name_only": 0.8, "structured": 0.7}
CHANNEL_DEPTHS = {"joint": 100, "name_only": 100, "address_only": 150, "structured": 100}
# The part of the pool that a gram of a lexical channel may be in.
CHANNEL_MAX_DF = {"joint": 0.4, "name_only": 0.5, "address_only": 0.5}
DUPLICATE_DISCOUNT = 0.99


def _ranked(scored: DataFrame, score: str = "rrf") -> DataFrame:
    order = W.partitionBy("qid").orderBy(F.col(score).desc(), "tid")
    return scored.withColumn(f"{score}_rank", F.row_number().over(order))


def stack(channels: Mapping[str, DataFrame], depths: Mapping[str, int] | None = None) -> DataFrame:
    """Channel results under one another, each to its depth."""
    out = None
    for name, hits in channels.items():
        part = hits.select(F.lit(name).alias("channel"), "qid", "tid", "score", "rank")
        if depths and name in depths:
            part = part.where(F.col("rank") <= depths[name])
        out = part if out is None else out.unionByName(part)
    return out


def union_with_sources(hits: DataFrame) -> DataFrame:
    """qid, tid, sources: a map from channel to its score and rank."""
    return hits.groupBy("qid", "tid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.struct("score", "rank").alias("found"))))).alias("sources"))


def weight_of(channel: Column, weights: Mapping[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[channel], F.lit(1.0))


def reciprocal_rank(hits: DataFrame, weights: Mapping[str, float] | None = CHANNEL_WEIGHTS, k: int = 60, digits: int = 12, from_zero: bool = False) -> DataFrame:
    """The weighted sum of 1 / (k + rank), largest first, ties by tid."""
    place = F.col("rank") - 1 if from_zero else F.col("rank")
    each = weight_of(F.col("channel"), weights) / (k + place)
    return _ranked(hits.groupBy("qid", "tid").agg(F.round(F.sum(each), digits).alias("rrf")))


def lookups(hits: DataFrame, channels: Iterable[str] = tuple(CHANNEL_WEIGHTS)) -> DataFrame:
    """One row a pair with each channel's score and rank side by side."""
    picked = [F.max(F.when(F.col("channel") == c, F.col(v))).alias(f"{c}_{v}") for c in channels for v in ("score", "rank")]
    return hits.groupBy("qid", "tid").agg(*picked)


def _classes(siblings: DataFrame) -> DataFrame:
    """tid, _class, _ids: the classes that an id belongs to, with all their members."""
    ids = F.array_sort(F.array_distinct(F.concat(F.array("tid"), "siblings")))
    return siblings.select("tid", F.struct(F.get(ids, F.lit(0)).alias("first"), F.xxhash64(ids).alias("ids")).alias("_class"), ids.alias("_ids"))


def _with_duplicates(pairs: DataFrame, siblings: DataFrame, *best: Column) -> DataFrame:
    """qid, tid (and aggregates of the parents): all members of the classes that a query's pairs belong to, each class once a query.

    Siblings are classes: each member's are all the others. So a query takes in a class once, however many of its members it has.
    """
    named = _classes(siblings)
    classes = pairs.join(session.unsent(named.select("tid", "_class")), "tid").groupBy("qid", "_class").agg(F.count(F.lit(1)).alias("_n"), *best)
    members = named.where(F.col("tid") == F.col("_class.first")).select("_class", F.explode("_ids").alias("tid"))
    return classes.join(session.unsent(members), "_class").drop("_class", "_n")


def expand_duplicates(ranking: DataFrame, siblings: DataFrame, discount: float = DUPLICATE_DISCOUNT, digits: int = 12, top: int | None = None) -> DataFrame:
    """Siblings that are not in a list enter it at a discount on their best parent; lists rank again.

    With ``top``, only the first ``top`` of each new list (``ranking`` has rrf_rank): a sibling that scores below its parent
    stays below all pairs that stand before the parent, so parents beyond ``top`` need not be followed.
    """
    less = F.round(discount * F.col("rrf"), digits)
    first = F.lit(True) if top is None else F.col("rrf_rank") <= top
    new = _with_duplicates(ranking.where(first | (less >= F.col("rrf"))).select("qid", "tid", "rrf"), siblings, F.max("rrf").alias("rrf"))
    # one shuffle, by query, serves what finds the pairs that are in a list already and what ranks
    all_ = ranking.select("qid", "tid", F.col("rrf").alias("_own"), first.alias("_kept"), F.lit(None).cast("double").alias("_rrf")).unionByName(
        new.select("qid", "tid", F.lit(None).cast("double").alias("_own"), F.lit(True).alias("_kept"), F.col("rrf").alias("_rrf"))
    )
    one = all_.repartition("qid").groupBy("qid", "tid").agg(F.max("_own").alias("_own"), F.min("_kept").alias("_kept"), F.max("_rrf").alias("_rrf"))
    out = _ranked(one.where("_kept").select("qid", "tid", F.coalesce("_own", F.round(discount * F.col("_rrf"), digits)).alias("rrf")))
    return out if top is None else out.where(F.col("rrf_rank") <= top)


def cover(ranking: DataFrame, required: DataFrame, top: int | None = 100) -> DataFrame:
    """Each required query with its first ``top`` pairs; a query without any has a null pair."""
    kept = ranking if top is None else ranking.where(F.col("rrf_rank") <= top)
    return required.select("qid").join(session.unsent(kept), "qid", "left")


def cumulative_unions(channels: Mapping[str, DataFrame], siblings: DataFrame | None = None) -> DataFrame:
    """step, qid, tid: after each channel, all distinct pairs so far; duplicates last."""
    out = so_far = None
    for step, (name, hits) in enumerate(channels.items(), 1):
        pairs = hits.select("qid", "tid").distinct()
        so_far = pairs if so_far is None else so_far.unionByName(pairs).distinct()
        named = so_far.select(F.lit(step).alias("step"), F.lit(name).alias("channel"), "qid", "tid")
        out = named if out is None else out.unionByName(named)
    if siblings is not None:
        more = _with_duplicates(so_far, siblings).select("qid", "tid")
        out = out.unionByName(so_far.unionByName(more).distinct().select(F.lit(len(channels) + 1).alias("step"), F.lit("duplicates").alias("channel"), "qid", "tid"))
    return out


def cumulative_sizes(channels: Mapping[str, DataFrame], siblings: DataFrame) -> DataFrame:
    """step, channel, n, n_queries: the sizes of :func:`cumulative_unions`, whose duplicates are counted by class.

    A class that shares no id with another adds its members to a query once, so their number is enough; members of other classes
    are listed and counted without repeats.
    """
    size = (F.count(F.lit(1)).alias("n"), F.countDistinct("qid").alias("n_queries"))
    steps = cumulative_unions(channels)
    pairs = session.written(steps.where(F.col("step") == len(channels)).select("qid", "tid"))
    named = _classes(siblings).dropDuplicates(["tid", "_class"]).withColumn("_in", F.count(F.lit(1)).over(W.partitionBy("tid")))
    named = session.written(named.withColumn("_shared", F.max(F.col("_in") > 1).over(W.partitionBy("_class"))).drop("_in"))
    of = pairs.join(session.unsent(named.select("tid", "_class", "_shared", F.size("_ids").alias("_size"))), "tid", "left")
    lists = session.written(of.groupBy("qid", "_class").agg(F.count(F.lit(1)).alias("_pairs"), F.max("_size").alias("_size"), F.max("_shared").alias("_shared")))
    whole = F.when(F.col("_class").isNull(), F.col("_pairs")).when(~F.col("_shared"), F.col("_size").cast("long")).otherwise(0)
    members = named.where(F.col("_shared") & (F.col("tid") == F.col("_class.first"))).select("_class", F.explode("_ids").alias("tid"))
    listed = lists.where("_shared").select("qid", "_class").join(session.unsent(members), "_class").select("qid", "tid").distinct()
    counted = lists.groupBy("qid").agg(F.sum(whole).alias("n")).unionByName(listed.select("qid", F.lit(1).cast("long").alias("n")))
    last = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.countDistinct("qid").alias("n_queries")).where("n > 0")
    return steps.groupBy("step", "channel").agg(*size).unionByName(last.select(F.lit(len(channels) + 1).alias("step"), F.lit("duplicates").alias("channel"), "n", "n_queries"))


def max_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("qid", "tid", "score").unionByName(b.select("qid", "tid", "score")).groupBy("qid", "tid").agg(F.max("score").alias("score"))


def one_owner(pairs: DataFrame, score: str = "score") -> DataFrame:
    """Each target only in the list of the query that scores it highest, ties by qid."""
    order = W.partitionBy("tid").orderBy(F.col(score).desc(), "qid")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def set_hash(ranking: DataFrame, score: str = "rrf") -> DataFrame:
    """qid, digest: SHA-256 of a query's pairs with scores to six digits, in id order."""
    item = F.concat_ws(":", "tid", F.format_string("%.6f", F.col(score)))
    return ranking.groupBy("qid").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ","), 256).alias("digest"))


def retrieve(queries: DataFrame, pool: DataFrame, depths: Mapping[str, int] = CHANNEL_DEPTHS, max_df: Mapping[str, float] = CHANNEL_MAX_DF) -> dict[str, DataFrame]:
    """The four channels of frames with name, address and country, each to its depth."""

    def texts(rows: DataFrame, key: str, mode: str) -> DataFrame:
        return rows.select(key, "country", text.channel_text(F.col("name"), F.col("address"), mode).alias("text"))

    out = {mode: lexical.channel(texts(queries, "qid", mode), texts(pool, "tid", mode), lexical.Config(max_df=max_df[mode], top=depths[mode])) for mode in ("joint", "name_only", "address_only")}
    return out | {"structured": blocking.structured(queries, pool, depths["structured"])}


def generate(queries: DataFrame, pool: DataFrame, channels: Mapping[str, DataFrame], siblings: DataFrame, top: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """Candidates without a look at the truth: fuse, expand, cover. Also the pairs' channel lookups.

    Each channel's hits and the fused ranking are written once each, as all are read more than once. A channel at a time, so that
    the driver plans, and plans anew after each stage, one search and not all of them together.
    """
    hits = stack({name: session.written(rows) for name, rows in channels.items()}, CHANNEL_DEPTHS)
    ranking = session.written(reciprocal_rank(hits))
    return cover(expand_duplicates(ranking, siblings, top=top), queries, top), lookups(hits, channels)


def generate_by_kind(queries: DataFrame, pool: DataFrame, siblings: DataFrame, top: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """:func:`generate` from the four channels, done once a kind: queries that are written alike have the same candidates.

    Frames have name, address and country. What is found for the first query of a kind goes to all of them at the end.
    """
    named, asked = blocking.by_kind(queries, "qid")
    found, channels = generate(asked.select("qid").distinct(), pool, retrieve(asked, pool), siblings, top)
    spread = lambda askers, rows: askers.join(session.unsent(rows.withColumnRenamed("qid", "kind")), "kind").drop("kind")
    rows = named.select("kind", "qid", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("kind", "qid")
    return spread(rows, session.written(found)), spread(named.select("kind", "qid"), channels)
