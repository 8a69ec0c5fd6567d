"""Blocking by structured keys: an inverted index with posting caps, scored by inverse block size.

The caps are part of the operator's meaning: keys above them say nothing about a pair. Records that are written alike
have the same keys, so one of each kind is searched, and postings count its copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera import session
from tessera.functions import fuzzy, text
from tessera.operators import products

# The most postings of a key, and a key's weight, by kind.
CAPS = {"exact": 500, "pin": 500, "bignum": 500, "house": 250, "prefix": 250, "token": 150, "loc": 150}
WEIGHTS = {"exact": 3.0, "pin": 2.5, "bignum": 2.0, "house": 1.5, "token": 1.0, "prefix": 1.0, "loc": 1.0}


def _kind(values: Column, name: str) -> Column:
    return F.transform(values, lambda k: F.struct(F.lit(name).alias("key_type"), k.alias("key")))


def keys(rows: DataFrame, id_col: str, stop: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """id, country, key_type, key (and the columns to ``keep``): repeats kept but for long numbers. Rows have name, address, country."""
    name, address = F.col("name"), F.col("address")
    names = F.filter(F.split(name, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*stop) if stop else F.length(t) >= 3)
    places = F.filter(F.split(address, " "), lambda t: F.length(t) >= 3)
    compact = F.replace(name, F.lit(" "), F.lit(""))
    none = F.array().cast("array<string>")
    house = F.regexp_extract(address, r"\b(\d{1,3})\b", 1)
    kinds = F.concat(
        _kind(F.when(name != "", F.array(name)).otherwise(none), "exact"),
        _kind(names, "token"),
        _kind(F.when(F.length(compact) >= 4, F.array(F.substring(compact, 1, 4))).otherwise(none), "prefix"),
        _kind(text.postal_codes(address), "pin"),
        _kind(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", name, address), F.lit(r"\b(\d{4,})\b"), F.lit(1))), "bignum"),
        _kind(F.when((house != "") & (F.size(places) > 0), F.array(F.concat(house, F.lit("|"), F.get(places, F.lit(0))))).otherwise(none), "house"),
        _kind(F.filter(places, lambda t: F.length(t) >= 6), "loc"),
    )
    return rows.select(id_col, *keep, "country", F.inline(kinds))


def _by_kind(table: dict, kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind]


def index(pool_keys: DataFrame) -> DataFrame:
    """Postings with their number, keys above their cap dropped. With ``copies``, a row stands for as many."""
    n = F.sum("copies") if "copies" in pool_keys.columns else F.count(F.lit(1))
    counts = pool_keys.groupBy("country", "key_type", "key").agg(n.alias("postings"))
    return pool_keys.join(session.unsent(counts.where(F.col("postings") <= _by_kind(CAPS, F.col("key_type")))), ["country", "key_type", "key"])


def overflow(pool_keys: DataFrame) -> DataFrame:
    """By kind: keys, keys above the cap, the longest posting list."""
    counts = pool_keys.groupBy("country", "key_type", "key").agg(F.count(F.lit(1)).alias("n"))
    over = F.sum((F.col("n") > _by_kind(CAPS, F.col("key_type"))).cast("long"))
    return counts.groupBy("key_type").agg(F.count(F.lit(1)).alias("n_keys"), over.alias("n_over"), F.max("n").alias("longest"))


def search(query_keys: DataFrame, postings: DataFrame, top: int = 200) -> DataFrame:
    """qid, tid, score, rank: the sum of weight / log2(2 + postings) over shared keys, ties by tid."""
    hits = session.unsent(query_keys).join(postings, ["country", "key_type", "key"])
    each = _by_kind(WEIGHTS, F.col("key_type")) / F.log2(F.lit(2.0) + F.col("postings"))
    scored = hits.groupBy("qid", "tid").agg(F.round(F.sum(each), 6).alias("score"))
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "tid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def alike(rows: DataFrame, id_col: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """The records as id, written, and their kinds as written, id (the smallest) and copies. Rows that repeat an id are one record with the keys of all.

    With ``by``, columns without nulls that an id has one value of, records of a kind agree in those too.
    """
    each = rows.groupBy(id_col, *by).agg(F.sort_array(F.collect_list(F.struct("country", "name", "address"))).alias("written"))
    return each, each.groupBy("written", *by).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def by_kind(rows: DataFrame, id_col: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """Each record's kind (kind, id, and _n, the rows that it had), and the rows of one record of each kind; both written."""
    each, kinds = alike(rows, id_col, *by)
    kinds = session.written(kinds)
    named = each.join(session.unsent(kinds.select("written", *by, F.col(id_col).alias("kind"))), ["written", *by])
    return session.written(named.select("kind", id_col, F.size("written").alias("_n"))), kinds.select(id_col, F.inline("written"))


def structured(queries: DataFrame, pool: DataFrame, top: int = 200, stop: tuple[str, ...] = ()) -> DataFrame:
    """:func:`search` of all records, done once a kind: a query's best records are among the first of its best kinds."""
    asked, asked_kinds = alike(queries, "qid")
    there, pool_kinds = alike(pool, "tid")
    asked_kinds, pool_kinds = session.written(asked_kinds), session.written(pool_kinds)
    rows = pool_kinds.select("tid", "copies", F.inline("written"))
    best = search(keys(asked_kinds.select("qid", F.inline("written")), "qid", stop), index(keys(rows, "tid", stop, ("copies",))), top)
    named = there.join(session.unsent(pool_kinds.select("written", F.col("tid").alias("kind"))), "written").select("kind", "tid")
    members = named.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy("tid"))).where(F.col("_n") <= top).drop("_n")
    found = products.records_of(best, pool_kinds.select("tid", "copies"), members, top)
    askers = asked.join(session.unsent(asked_kinds.select("written", F.col("qid").alias("kind"))), "written").select("kind", "qid")
    return askers.join(session.unsent(found.withColumnRenamed("qid", "kind")), "kind").select("qid", "tid", "score", "rank")


def pin_block(queries: DataFrame, pool: DataFrame, most: int = 40) -> DataFrame:
    """Pairs of one postal code, the first ``most`` of the pool by id."""
    q = queries.withColumn("pin", text.first_postal(F.col("address"))).where(F.col("pin") != "")
    p = pool.withColumn("pin", text.first_postal(F.col("address")))
    ranked = p.withColumn("rank", F.row_number().over(W.partitionBy("pin").orderBy("tid"))).where(F.col("rank") <= most)
    return q.select("qid", "pin").join(ranked.select("tid", "pin", "rank"), "pin").select("qid", "tid", "rank")


def backfill(
    queries: DataFrame, pool: DataFrame, found: DataFrame, weak: DataFrame, likeness: Callable[[Column, Column], Column] = fuzzy.wratio, per_key: int = 200, cap: int = 500, least: float = 0.6, top: int = 10, most: int = 60
) -> DataFrame:
    """qid, tid, score, rank: the lists of ``found``, those of the weak queries with more pairs.

    The new pairs share the sound of the first name token or a house number, within a country; keys
    above ``cap`` postings say nothing, of others the first ``per_key`` by tid count. The ``top`` likest by their search
    texts, at ``least`` or more, join the list, which keeps its ``most`` best. Frames have name, address, country, text.
    """
    sound = F.struct(F.lit("sound").alias("kind"), text.soundex(F.get(F.split("name", " "), F.lit(0))).alias("key"))
    houses = _distinct_numbers(F.col("address"))
    kinds = F.concat(F.array(sound), F.transform(houses, lambda n: F.struct(F.lit("house").alias("kind"), n.alias("key"))))
    q = queries.join(weak.select("qid"), "qid", "left_semi").select("qid", "country", F.inline(kinds))
    p = pool.select("tid", "country", F.inline(kinds))
    key = W.partitionBy("country", "kind", "key")
    p = p.withColumn("_all", F.count(F.lit(1)).over(key)).withColumn("_n", F.row_number().over(key.orderBy("tid"))).where((F.col("_all") <= cap) & (F.col("_n") <= per_key))
    new = q.join(p, ["country", "kind", "key"]).select("qid", "tid").distinct().join(found.select("qid", "tid"), ["qid", "tid"], "left_anti")
    texts = new.join(queries.select("qid", F.col("text").alias("a")), "qid").join(pool.select("tid", F.col("text").alias("b")), "tid")
    scored = texts.select("qid", "tid", F.round(likeness(F.col("a"), F.col("b")), 6).alias("score")).where(F.col("score") >= least)
    added = products.ranked(scored, top).select("qid", "tid", "score")
    mine = found.join(weak.select("qid"), "qid", "left_semi").select("qid", "tid", "score")
    others = found.join(weak.select("qid"), "qid", "left_anti").select("qid", "tid", "score", "rank")
    return products.ranked(mine.unionByName(added), most).unionByName(others)


def _distinct_numbers(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(address, F.lit(r"(?<![\p{L}\p{N}_])(\d{1,6})(?![\p{L}\p{N}_])"), F.lit(1)))


def duplicates(pool: DataFrame) -> DataFrame:
    """tid, siblings: ids with the same non-blank name and address."""
    groups = pool.where((F.trim("name") != "") & (F.trim("address") != "")).groupBy("name", "address").agg(F.array_sort(F.collect_list("tid")).alias("ids")).where(F.size("ids") > 1)
    return groups.select(F.explode("ids").alias("tid"), "ids").select("tid", F.array_remove(F.col("ids"), F.col("tid")).alias("siblings"))


def missed_targets(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """True targets in no candidate list."""
    return truth.join(candidates.select("tid").distinct(), "tid", "left_anti").select("tid").distinct()
