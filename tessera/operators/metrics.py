"""Entity-macro F0.5 and the reports around it.

Per-query counts are n_true, n_pred, n_tp for every required query, whether it has pairs or not.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera import session


def f05(n_true: Column, n_pred: Column, n_tp: Column) -> Column:
    """An empty truth scores 1 for an empty prediction, else 0; an empty prediction 0; else 5 TP / (|G| + 4 |P|)."""
    empty = F.when(n_pred == 0, 1.0).otherwise(0.0)
    return F.when(n_true == 0, empty).when(n_pred == 0, 0.0).otherwise(5.0 * n_tp / (n_true + 4 * n_pred))


def f05_by_rates(n_true: Column, n_pred: Column, n_tp: Column) -> Column:
    """The same by precision and recall."""
    p, r = F.try_divide(n_tp, n_pred), F.try_divide(n_tp, n_true)
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when((n_pred == 0) | (n_tp == 0), 0.0).otherwise(F.try_divide(1.25 * p * r, 0.25 * p + r))


def counts(required: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The required rows with n_true, n_pred and n_tp."""
    t, p = truth.select("qid", "tid").distinct(), predicted.select("qid", "tid").distinct()
    n_true = t.groupBy("qid").agg(F.count(F.lit(1)).alias("n_true"))
    hit = p.join(t.withColumn("hit", F.lit(1)), ["qid", "tid"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("n_tp"))
    return required.join(n_true, "qid", "left").join(hit, "qid", "left").na.fill(0, ["n_true", "n_pred", "n_tp"])


def per_query(required: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return counts(required, truth, predicted).withColumn("f05", f05(F.col("n_true"), F.col("n_pred"), F.col("n_tp")))


def macro(scores: DataFrame) -> float:
    row = scores.agg(F.avg("f05").alias("m"), F.count(F.lit(1)).alias("n")).collect()[0]
    if not row["n"]:
        raise ValueError("the truth is empty")
    return row["m"]


def oracle(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best prediction that the candidates allow."""
    return truth.select("qid", "tid").join(candidates.select("qid", "tid").distinct(), ["qid", "tid"], "left_semi")


def candidate_report(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of candidate counts: oracle F0.5, pair recall, list length, full and zero hits, singletons."""
    best = f05(F.col("n_true"), F.col("n_tp"), F.col("n_tp"))
    some = F.col("n_true") > 0
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(best), 6).alias("oracle_f05"),
        F.round(F.try_divide(F.sum("n_tp"), F.sum("n_true")), 6).alias("pair_recall"),
        F.round(F.avg("n_pred"), 6).alias("mean_k"),
        F.round(F.avg(F.when(some, (F.col("n_tp") == F.col("n_true")).cast("double"))), 6).alias("all_retrieved"),
        F.round(F.avg(F.when(some, (F.col("n_tp") == 0).cast("double"))), 6).alias("zero_hit"),
        F.sum((~some).cast("long")).alias("n_singletons"),
    )


def summarize(scores: DataFrame) -> DataFrame:
    """country (null for all), macro F0.5, queries, share of empty predictions: one pass for total and parts."""
    named = scores.withColumn("country", F.coalesce("country", F.lit("?")))
    return named.rollup("country").agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("n_pred") == 0).cast("double")), 6).alias("empty_rate"))


def losses(scores: DataFrame, oracle_scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What retrieval loses, and what the matcher loses of what it was given."""
    both = scores.join(oracle_scores.select("qid", F.col("f05").alias("oracle_f05")), "qid")
    return both.groupBy(*by).agg(F.round(F.avg(1 - F.col("oracle_f05")), 6).alias("retrieval_loss"), F.round(F.avg(F.col("oracle_f05") - F.col("f05")), 6).alias("matcher_loss"), F.round(F.avg(1 - F.col("f05")), 6).alias("total_loss"))


def singletons(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    own = scores.where(F.col("n_true") == 0)
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_pred") == 0).cast("long")).alias("n_right"), F.sum((F.col("n_pred") > 0).cast("long")).alias("n_false_merges"))


def error_kind() -> Column:
    fp, fn = F.col("n_pred") > F.col("n_tp"), F.col("n_true") > F.col("n_tp")
    return F.when(fp & fn, "both").when(fp, "fp_only").when(fn, "fn_only").otherwise("perfect")


def error_report(scores: DataFrame) -> DataFrame:
    """By kind of error: queries, share of the loss, and F0.5 without the false or with the missing pairs."""
    no_fp = f05(F.col("n_true"), F.col("n_tp"), F.col("n_tp"))
    no_fn = f05(F.col("n_true"), F.col("n_pred") + F.col("n_true") - F.col("n_tp"), F.col("n_true"))
    return scores.withColumn("kind", error_kind()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(1 - F.col("f05")), 6).alias("loss"), F.round(F.sum(no_fp), 6).alias("without_fp"), F.round(F.sum(no_fn), 6).alias("without_fn"))


def micro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.try_divide(F.sum("n_tp"), F.sum("n_pred")), 6).alias("precision"), F.round(F.try_divide(F.sum("n_tp"), F.sum("n_true")), 6).alias("recall"), F.sum(((F.col("n_pred") == 0) & (F.col("n_true") > 0)).cast("long")).alias("false_empty"))


def slices(scores: DataFrame, members: dict[str, Column]) -> DataFrame:
    """The macro score within each membership, in one pass."""
    return scores.agg(*[F.round(F.avg(F.when(c, F.col("f05"))), 6).alias(name) for name, c in members.items()])


def recall_in_pool(truth: DataFrame, pool: DataFrame, ranking: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """Recall at ``k`` over the true targets that the pool has."""
    there = truth.join(pool.select("tid"), "tid", "left_semi")
    hit = there.join(ranking.where(F.col(rank) <= k).select("qid", "tid").withColumn("hit", F.lit(1)), ["qid", "tid"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_hit"), F.round(F.try_divide(F.count("hit"), F.count(F.lit(1))), 6).alias("recall"))


# Recall gates in per cent, by country and over all.
RECALL_GATES = {"India": 88.0, "__default__": 95.0, "__all__": 92.0}


def recall_gates(counted: DataFrame) -> DataFrame:
    """country (null for all), recall in per cent, and whether it passes its gate."""
    gate = F.when(F.col("country").isNull(), RECALL_GATES["__all__"]).when(F.col("country") == "India", RECALL_GATES["India"]).otherwise(RECALL_GATES["__default__"])
    some = counted.where(F.col("n_true") > 0).rollup("country").agg(F.round(F.lit(100.0) * F.try_divide(F.sum("n_tp"), F.sum("n_true")), 6).alias("recall_pct"))
    return some.withColumn("passes", F.col("recall_pct") >= gate)


def hit_samples(truth: DataFrame, candidates: DataFrame, countries: DataFrame, n: int = 3) -> DataFrame:
    """country, hit, qid, tid: the first few retrieved and missed links of each country, for a report."""
    named = truth.join(candidates.select("qid", "tid").distinct().withColumn("_hit", F.lit(True)), ["qid", "tid"], "left").join(countries, "qid").withColumn("hit", F.coalesce("_hit", F.lit(False)))
    order = W.partitionBy("country", "hit").orderBy("qid", "tid")
    return named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select("country", "hit", "qid", "tid")


def depth_frontier(required: DataFrame, truth: DataFrame, ranking: DataFrame, depths: Sequence[int | None]) -> DataFrame:
    """The candidate report of one ranking cut at each depth (null: all of it), in one pass over its pairs.

    Links and ranked pairs are dealt by query once; what tells them apart and what counts them follows without another shuffle.
    """
    within = lambda k: F.lit(True) if k is None else F.col("rrf_rank") <= k
    ranked = ranking.select("qid", "tid", *[within(k).cast("int").alias(f"_n{i}") for i, k in enumerate(depths)], F.lit(0).alias("_true"))
    linked = truth.select("qid", "tid", *[F.lit(0).alias(f"_n{i}") for i, _ in enumerate(depths)], F.lit(1).alias("_true"))
    pairs = ranked.unionByName(linked).repartition("qid").groupBy("qid", "tid").agg(F.max("_true").alias("_true"), *[F.sum(f"_n{i}").alias(f"_n{i}") for i, _ in enumerate(depths)])
    hit = (F.col("_true") == 1) & F.col("tid").isNotNull()
    count = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    cuts = [F.struct(F.lit(k).cast("int").alias("k"), count(f"_n{i}").alias("n_pred"), count(F.when(hit, F.col(f"_n{i}"))).alias("n_tp")) for i, k in enumerate(depths)]
    empty = [F.struct(F.lit(k).cast("int").alias("k"), F.lit(0).cast("long").alias("n_pred"), F.lit(0).cast("long").alias("n_tp")) for k in depths]
    found = pairs.groupBy("qid").agg(count("_true").alias("n_true"), F.array(*cuts).alias("cuts"))
    all_ = required.join(session.unsent(found), "qid", "left").na.fill(0, ["n_true"])
    return candidate_report(all_.select("qid", "n_true", F.inline(F.coalesce("cuts", F.array(*empty)))), ["k"])


def paired_bootstrap(a: DataFrame, b: DataFrame, n: int = 1000, seed: int = 0, by: str | None = None, bins: int = 4096) -> dict[str, float]:
    """The mean difference b - a of F0.5 and its 95 % interval, resampled within ``by`` if given.

    Queries with equal differences are alike, so a resample draws how often each value comes up: the
    driver gets the counts of at most ``bins`` rounded values a group, not the queries.
    """
    key = [by] if by else []
    diffs = a.select("qid", *key, F.col("f05").alias("x")).join(b.select("qid", F.col("f05").alias("y")), "qid")
    step = 2.0 / bins
    table = diffs.groupBy(*key, F.round((F.col("y") - F.col("x")) / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") - F.col("x")).alias("d")).toPandas()
    if not len(table):
        return {"delta": 0.0, "low": 0.0, "high": 0.0}
    rng, total = np.random.default_rng(seed), table["n"].sum()
    sums = np.zeros(n)
    for _, part in table.groupby(by) if by else [(None, table)]:
        size = int(part["n"].sum())
        sums += rng.multinomial(size, part["n"].to_numpy() / size, n) @ part["d"].to_numpy()
    low, high = np.percentile(sums / total, [2.5, 97.5])
    return {"delta": float((table["n"] * table["d"]).sum() / total), "low": float(low), "high": float(high)}


def resampled(a: DataFrame, b: DataFrame, n: int = 200, seed: str = "bootstrap", by: str | None = None) -> DataFrame:
    """delta, low, high: the same with every draw made from a hash, so that any engine draws alike.

    A resample draws as many queries from each group as it has, with replacement: ``n`` rows a query. For
    very many queries take :func:`paired_bootstrap`, whose work does not grow with them.
    """
    group = F.col(by) if by else F.lit("")
    diffs = a.select("qid", group.alias("grp"), F.col("f05").alias("x")).join(b.select("qid", F.col("f05").alias("y")), "qid").select("qid", "grp", (F.col("y") - F.col("x")).alias("d"))
    w = W.partitionBy("grp")
    placed = diffs.withColumn("place", F.row_number().over(w.orderBy("qid")) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    draws = placed.select("grp", "size", "place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "grp", F.col("b").cast("string"), F.col("place").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = draws.select("grp", "b", (number % F.col("size")).cast("int").alias("place"))
    means = drawn.join(placed.select("grp", "place", "d"), ["grp", "place"]).groupBy("b").agg(F.avg("d").alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return diffs.agg(F.round(F.avg("d"), 9).alias("delta")).join(ends.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high")))
