"""From scores to matches: thresholds, their tuning, policies by country."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.operators import metrics

# The grids of the threshold searches.
DIAGONAL = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
SINGLETON_GRID = (0.6, 0.7, 0.75, 0.8, 0.82, 0.85, 0.88, 0.9, 0.92, 0.95)
MATCH_GRID = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)
BASE_POLICY = (0.7, 0.7)
#: The policies' grid (0.05 to 0.995 by 0.005) and the free tuner's (0.3 to 0.9 by 0.05).
POLICY_GRID = tuple(round(i / 1000, 3) for i in range(50, 1000, 5))
FREE_GRID = tuple(round(i / 100, 2) for i in range(30, 91, 5))


def two_threshold(scored: DataFrame, ts: Column | float, tm: Column | float, score: str = "p") -> DataFrame:
    """Pairs kept: none of a query whose best score is below ts, else those from tm on."""
    best = F.max(score).over(W.partitionBy("qid"))
    return scored.withColumn("_best", best).where((F.col("_best") >= ts) & (F.col(score) >= tm)).drop("_best")


def single_threshold(scored: DataFrame, least: float, score: str = "p") -> DataFrame:
    return scored.where(F.col(score) >= least)


def grid(spark, singles: Sequence[float], matches: Sequence[float], ordered: bool = True) -> DataFrame:
    cells = [(float(a), float(b)) for a in singles for b in matches if not ordered or b <= a]
    return spark.createDataFrame(cells, "ts double, tm double")


def _reached(x: Column, grid: Sequence[float]) -> Column:
    """How many values of an ascending grid ``x`` reaches, by bisection."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(x >= grid[middle], part(middle + 1, hi)).otherwise(part(lo, middle))

    return part(0, len(grid))


def sweep(scored: DataFrame, truth: DataFrame, cells: DataFrame, groups: bool = False) -> DataFrame:
    """ts, tm, macro_f05 of each cell, over all queries of ``truth`` counts (qid, n_true).

    With ``groups``, also grp: 'global' and each country of ``truth``, in the same pass.

    ``scored`` has qid, p, is_match. A query's score changes over the tm grid only at its own pairs, so it
    gives one step up and one down for each of them; summed by the place of its best score on the ts
    grid, running sums over both grids are the scores of all cells. No query meets a cell.
    """
    wanted = [(r["ts"], r["tm"]) for r in cells.collect()]  # a bounded grid
    singles, matches = (sorted({c[i] for c in wanted}) for i in (0, 1))
    n_k = len(matches)
    down = W.partitionBy("qid").orderBy(F.col("b").desc())
    best = scored.groupBy("qid").agg(_reached(F.max("p"), singles).alias("i"))
    at = scored.groupBy("qid", _reached(F.col("p"), matches).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("is_match").alias("tp")).where(F.col("b") > 0)
    running = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = at.select("qid", F.coalesce(F.lead("b").over(down), F.lit(0)).alias("from"), F.col("b").alias("to"), F.sum("n").over(running).alias("n_pred"), F.sum("tp").over(running).alias("n_tp"))
    above = at.groupBy("qid").agg(F.max("b").alias("from")).select("qid", "from", F.lit(n_k).alias("to"), F.lit(0).cast("long").alias("n_pred"), F.lit(0).cast("long").alias("n_tp"))
    named = truth.select("qid", "n_true", (F.array(F.lit("global"), F.col("country")) if groups else F.array(F.lit("global"))).alias("grp"))
    named = named.join(best, "qid", "left").select("qid", "n_true", F.explode("grp").alias("grp"), F.coalesce("i", F.lit(0)).alias("i"))
    empty = metrics.f05(F.col("n_true"), F.lit(0), F.lit(0))
    parts = named.join(steps.unionByName(above), "qid", "left")
    value = F.when(F.col("from").isNull(), empty).otherwise(metrics.f05(F.col("n_true"), F.col("n_pred"), F.col("n_tp")))
    lo, hi = F.coalesce("from", F.lit(0)), F.coalesce("to", F.lit(n_k))
    jumps = parts.select("grp", "i", F.inline(F.array(F.struct(lo.alias("k"), value.alias("d")), F.struct(hi.alias("k"), (-value).alias("d"))))).groupBy("grp", "i", "k").agg(F.sum("d").alias("d"))
    totals = named.groupBy("grp", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(empty).alias("e"))
    # all places of both grids for each group: the running sums need every one
    all_i = F.explode(F.sequence(F.lit(0), F.lit(len(singles)))).alias("i")
    dense = totals.select("grp").distinct().select("grp", all_i).join(totals, ["grp", "i"], "left").na.fill(0)
    up = W.partitionBy("grp").orderBy("i")
    dense = dense.withColumn("lost", F.coalesce(F.sum("e").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("all", F.sum("n").over(W.partitionBy("grp")))
    dense = dense.select("grp", "i", "lost", "all", F.explode(F.sequence(F.lit(0), F.lit(n_k - 1))).alias("k")).join(jumps, ["grp", "i", "k"], "left").na.fill(0.0, ["d"])
    own = F.sum("d").over(W.partitionBy("grp", "i").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    reach = W.partitionBy("grp", "k").orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = dense.withColumn("own", own).withColumn("kept", F.sum("own").over(reach))
    places = cells.sparkSession.createDataFrame([(ts, tm, singles.index(ts) + 1, matches.index(tm)) for ts, tm in dict.fromkeys(wanted)], "ts double, tm double, i int, k int")
    out = summed.join(F.broadcast(places), ["i", "k"])
    return out.select(*["grp"] * groups, "ts", "tm", F.round((F.col("kept") + F.col("lost")) / F.col("all"), 9).alias("macro_f05"))


# The weights that score fusion tries.
FUSION_WEIGHTS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)


def sweep_fusion(scored: DataFrame, truth: DataFrame, policy: DataFrame, weights: Sequence[float] = FUSION_WEIGHTS, other: str = "cosine") -> DataFrame:
    """w, macro_f05: the policy's result on (1 - w) p + w cosine, for each weight. ``truth`` has qid, n_true."""
    each = scored.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights]))).withColumn("p", (1 - F.col("w")) * F.col("p") + F.col("w") * F.col(other))
    # a query at a weight decides on its own
    keyed = each.withColumn("_qid", F.col("qid")).withColumn("qid", F.concat_ws("|", "qid", "w"))
    kept = apply_policy(keyed, policy).groupBy("w", F.col("_qid").alias("qid")).agg(F.count(F.lit(1)).alias("n_pred"), F.sum("is_match").alias("n_tp"))
    all_ = truth.select("qid", "n_true", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w"))
    counts = all_.join(kept, ["w", "qid"], "left").na.fill(0, ["n_pred", "n_tp"])
    return counts.groupBy("w").agg(F.round(F.avg(metrics.f05(F.col("n_true"), F.col("n_pred"), F.col("n_tp"))), 9).alias("macro_f05"))


def best_cell(swept: DataFrame, prefer_high: bool = False) -> DataFrame:
    """The best cell; ties go to the smaller thresholds, or to the larger sum of them."""
    order = [F.col("macro_f05").desc(), (F.col("ts") + F.col("tm")).desc()] if prefer_high else [F.col("macro_f05").desc(), "ts", "tm"]
    return swept.orderBy(*order, "ts", "tm").limit(1)


def select_policies(scored: DataFrame, truth: DataFrame, cells: DataFrame) -> DataFrame:
    """grp ('global' and each country), ts, tm, macro_f05: the best dual threshold that beats the base policy."""
    swept = sweep(scored, truth, cells, groups=True)
    is_base = (F.col("ts") == BASE_POLICY[0]) & (F.col("tm") == BASE_POLICY[1])
    own = W.partitionBy("grp")
    base = F.max(F.when(is_base, F.col("macro_f05"))).over(own)
    better = swept.withColumn("base", base).where(is_base | (F.col("macro_f05") > F.col("base") + 1e-12))
    first = F.row_number().over(own.orderBy(F.col("macro_f05").desc(), "ts", "tm"))
    return better.withColumn("_n", first).where(F.col("_n") == 1).select("grp", "ts", "tm", "macro_f05")


def apply_policy(scored: DataFrame, policy: DataFrame, score: str = "p") -> DataFrame:
    """Thresholds by country, the group 'global' where a country has none."""
    fallback = policy.where(F.col("grp") == "global").select(F.col("ts").alias("_gs"), F.col("tm").alias("_gm"))
    named = scored.join(F.broadcast(policy.where(F.col("grp") != "global").select(F.col("grp").alias("country"), "ts", "tm")), "country", "left").join(F.broadcast(fallback))
    return two_threshold(named, F.coalesce("ts", "_gs"), F.coalesce("tm", "_gm"), score).drop("ts", "tm", "_gs", "_gm")
