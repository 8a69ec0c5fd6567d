"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only.

1. A document's size is its number of words. Sources in code-point order (null last) weigh 5, 2, 1,
   repeating, and share 150 % of all words; a target stops at twice its source's words and the
   excess goes to the others by weight, until none is above (water filling, in closed form).
2. The targets make blocks of ``b`` words. Sainte-Lague gives the blocks to sources by the highest
   quotients ``target / (2 k + 1)``, then each source's blocks to its shards the same way. Only seats
   whose quotient can be near the cut are listed, so a listing is as long as the table of parties.
3. A shard lays its documents out twice, in seeded order, and cuts that into blocks; the quota's
   blocks with the smallest seeded hashes are taken. A document's ``taken`` is its overlap with them,
   so it is at most twice its size.

Shards of a source and rows of a shard both grow as the square root of the source's rows, so no
group of a window grows with a hot source.

Defined cases: a null text has size 0 and a size-0 document takes 0; a source without words has
target 0; an empty table gives no rows; rows with equal ids are rows of their own (the order
breaks ties by size, equal rows are interchangeable); other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tessera.llm import common

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: The most words of a block, and the blocks that small inputs are cut into.
BLOCK_WORDS, LEAST_BLOCKS = 1024, 65536
#: The least rows of a shard.
SHARD_ROWS = 160
#: So many sources at most are sent to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def n_words(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` a text holds."""
    marked = F.regexp_replace(text, _WORD, "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(marked)).otherwise(0).cast("long")


def _apportion(parties: DataFrame, by: list[str], votes: str, total: str, seats: str) -> DataFrame:
    """Sainte-Lague within each group ``by``: ``total`` seats to the rows, ties by key. Exact.

    With ``m`` parties the divisor at the cut lies between ``V / (N + m / 2)`` and ``V / (N - m / 2)``,
    so a party surely has the seats of the larger divisor and never more than those of the smaller.
    """
    w = W.partitionBy(*by)
    v, n = F.col(votes).cast("double"), F.col(total).cast("double")
    wide = parties.withColumn("_m", F.count(F.lit(1)).over(w) + F.lit(2.0)).withColumn("_v", F.sum(v).over(w))
    low = F.when(F.col("_v") > 0, F.floor(v * F.greatest(n - F.col("_m") / 2, F.lit(0.0)) / F.col("_v") + 0.5)).otherwise(0)
    high = F.when(F.col("_v") > 0, F.floor(v * (n + F.col("_m") / 2) / F.col("_v") + 0.5)).otherwise(0)
    sure = wide.withColumn("_low", F.greatest(low - 1, F.lit(0))).withColumn("_high", high + 1).withColumn("_left", F.col(total) - F.sum("_low").over(w))
    keys = [*by, "_key"]
    open_ = (
        sure.where(v > 0).select(*keys, votes, "_left", F.explode(F.sequence("_low", "_high")).alias("_k"))
        .withColumn("_rank", F.row_number().over(w.orderBy((v / (2 * F.col("_k") + 1)).desc(), "_key", "_k")))
        .where(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    )
    return sure.join(open_, keys, "left").withColumn(seats, (F.col("_low") + F.coalesce("_more", F.lit(0))).cast("long")).drop("_m", "_v", "_low", "_high", "_left", "_more")


def source_targets(sources: DataFrame) -> DataFrame:
    """From (skey, source, rows, source_size): the weight, the target and the blocks of each source."""
    order = W.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(x)) for x in WEIGHTS])
    all_ = W.partitionBy()
    s = (
        sources.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
        .withColumn("cap", (REPEATS * F.col("source_size")).cast("double"))
        .withColumn("goal", SHARE * F.sum("source_size").over(all_))
    )
    up = W.orderBy(F.col("cap") / F.col("weight"), "skey")
    below = F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1))
    above = F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("level", (F.col("goal") - F.coalesce(below, F.lit(0.0))) / above)
    s = s.withColumn("level", F.max("level").over(all_))  # it rises as long as a source is above its cap
    s = s.withColumn("target", F.when(F.col("cap") == 0, 0.0).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK_WORDS)), F.floor(F.col("goal") / LEAST_BLOCKS).cast("double")))
    s = s.withColumn("block", block).withColumn("n_blocks", F.round(F.sum("target").over(all_) / F.col("block")).cast("long"))
    s = s.withColumn("_key", F.col("skey")).withColumn("_all", F.lit(0))
    return _apportion(s, ["_all"], "target", "n_blocks", "quota").select("skey", "source", "rows", "source_size", "target", "block", "quota")


def mix(docs: DataFrame, seed: int = 17, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, and source: how many words of each document the mix takes."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "mix")
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))
    sized = scratch.put(docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), key.alias("skey"), n_words(common.as_text(text)).alias("size")), "sizes")
    sources = sized.groupBy("skey").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    sources = scratch.put(source_targets(sources), "sources")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    shards = F.ceil(F.col("rows") / F.greatest(F.lit(float(SHARD_ROWS)), F.sqrt("rows")))
    plan = sources.drop("source").withColumn("shards", shards)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    dealt = sized.join(F.broadcast(plan) if few else plan, "skey").withColumn("order", order).withColumn("shard", F.pmod(order, F.col("shards")))
    group = ["skey", "shard"]
    totals = dealt.groupBy(*group).agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("block").alias("block"))
    totals = _apportion(totals.withColumn("_key", F.col("shard")), ["skey"], "words", "quota", "taken_blocks")
    blocks = F.greatest(F.col("taken_blocks"), F.round(REPEATS * F.col("words") / F.col("block"))).cast("long")
    totals = totals.withColumn("blocks", F.greatest(blocks, F.lit(1).cast("long")))
    hashes = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64(F.lit(seed + 1), F.col("skey"), F.col("shard"), j)))
    totals = totals.select(*group, "words", "blocks", "taken_blocks", F.when(F.col("taken_blocks") > 0, F.element_at(hashes, F.col("taken_blocks").cast("int"))).alias("cut"))
    w = W.partitionBy(*group).orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = dealt.withColumn("end", F.sum("size").over(w)).join(totals, group)
    return laid.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, _taken(seed)).otherwise(0).cast("long").alias("taken"))


def _taken(seed: int) -> Column:
    """Words of [end - size, end) in each repeat that lie in chosen blocks. Block j is [j L / K, (j + 1) L / K), L words laid out."""
    total = REPEATS * F.col("words")
    edge = lambda j: F.floor(j * total / F.col("blocks"))

    def one(r: int) -> Column:
        lo, hi = r * F.col("words") + F.col("end") - F.col("size"), r * F.col("words") + F.col("end")
        first = F.greatest(F.floor(lo * F.col("blocks") / total) - 1, F.lit(0))
        last = F.least(F.floor(hi * F.col("blocks") / total) + 1, F.col("blocks") - 1)
        own = lambda j: F.greatest(F.least(edge(j + 1), hi) - F.greatest(edge(j), lo), F.lit(0))
        picked = lambda j: F.xxhash64(F.lit(seed + 1), F.col("skey"), F.col("shard"), j) <= F.col("cut")
        return F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, j: a + F.when(picked(j), own(j)).otherwise(0).cast("long"))

    return sum((one(r) for r in range(1, REPEATS)), one(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).drop("source")
