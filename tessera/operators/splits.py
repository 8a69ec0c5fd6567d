"""Seeded hashing, splits, samples and role manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# The seed that the splits are drawn with.
SPLIT_SEED = "f05-v1"


def seeded_hex(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + "|"), key), 256)


def group_key(key: Column, seed: str = SPLIT_SEED) -> Column:
    """The first 64 bits of the seeded SHA-256, unsigned."""
    return F.conv(F.substring(seeded_hex(seed, key), 1, 16), 16, 10).cast("decimal(20,0)")


def assign_split(key: Column, seed: str = SPLIT_SEED, shares: tuple[int, int, int] = (80, 10, 10)) -> Column:
    place = (group_key(key, seed) % F.lit(sum(shares)).cast("decimal(20,0)")).cast("int")
    return F.when(place < shares[0], "train").when(place < shares[0] + shares[1], "dev").otherwise("holdout")


def exposed(key: Column) -> Column:
    """Whether the first MD5 byte divides by ten."""
    return F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int") % 10 == 0


def build_splits(ids: DataFrame, key: str, seed: str = SPLIT_SEED) -> DataFrame:
    k = F.col(key)
    return ids.withColumn("split", F.when(exposed(k), "dev-exposed").otherwise(assign_split(k, seed)))


def match_bucket(n: Column) -> Column:
    return F.when(n == 0, "0-singleton").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").otherwise("6+")


def crosstab(splits: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """split, bucket, n. ``counts`` has the key and n_matches; ids without a row have none."""
    joined = splits.join(counts, key, "left").withColumn("bucket", match_bucket(F.coalesce("n_matches", F.lit(0))))
    return joined.groupBy("split", "bucket").agg(F.count(F.lit(1)).alias("n"))


def sample(ids: DataFrame, key: str, n: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` ids with the smallest seeded hashes, of each group ``by``."""
    ranked = ids.withColumn("_h", seeded_hex(seed, F.col(key)))
    if not by:
        return ranked.orderBy("_h", key).limit(n).drop("_h")
    return ranked.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("_h", key))).where(F.col("_n") <= n).drop("_h", "_n")


def slice_sorted(ids: DataFrame, key: str, first: int, n: int) -> DataFrame:
    """``n`` ids in order from place ``first`` (0 is the smallest)."""
    return ids.orderBy(key).offset(first).limit(n)


def roles(ids: DataFrame, key: str, sizes: dict[str, int], by: str, seed: str = "roles") -> DataFrame:
    """id, role: chained samples; each role draws from what the roles before it left."""
    left, out = ids, None
    for role, n in sizes.items():
        drawn = sample(left, key, n, f"{seed}|{role}", [by])
        named = drawn.select(key, by, F.lit(role).alias("role"))
        out = named if out is None else out.unionByName(named)
        left = left.join(drawn.select(key), key, "left_anti")
    return out


def subset_role(manifest: DataFrame, key: str, role: str, of: str, sizes: int, by: str, seed: str = "roles") -> DataFrame:
    """The manifest with one more role, drawn from the ids of another, which keep that one too."""
    drawn = sample(manifest.where(F.col("role") == of), key, sizes, f"{seed}|{role}", [by])
    return manifest.unionByName(drawn.select(key, by, F.lit(role).alias("role")))


def outside_role(manifest: DataFrame, key: str, role: str, of: str) -> DataFrame:
    """Ids of a role that should all have another, and do not."""
    return manifest.where(F.col("role") == role).select(key).join(manifest.where(F.col("role") == of), key, "left_anti")


def overlaps(manifest: DataFrame, key: str, subsets: Sequence[str] = ()) -> DataFrame:
    """Ids that have more than one role, besides roles within others (``subsets``)."""
    return manifest.where(~F.col("role").isin(*subsets) if subsets else F.lit(True)).groupBy(key).agg(F.countDistinct("role").alias("n_roles")).where(F.col("n_roles") > 1)


def uncovered(required: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return required.join(manifest, key, "left_anti").select(key)


def folds(key: Column, n: int = 3, seed: str = "folds") -> Column:
    return (group_key(key, seed) % F.lit(n).cast("decimal(20,0)")).cast("int")


def negatives(pairs: DataFrame, positives: DataFrame, times: int = 6, for_singletons: int = 12, seed: str = "negatives") -> DataFrame:
    """Of each query's pairs that are not true, ``times`` its true links (at least one), in hash order."""
    counts = positives.groupBy("qid").agg(F.count(F.lit(1)).alias("n_true"))
    wrong = pairs.join(positives, ["qid", "tid"], "left_anti").join(counts, "qid", "left")
    most = F.when(F.col("n_true").isNull(), for_singletons).otherwise(F.greatest(F.lit(1), times * F.col("n_true")))
    order = W.partitionBy("qid").orderBy(seeded_hex(seed, F.concat_ws("|", "qid", "tid")), "tid")
    return wrong.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("qid", "tid")
