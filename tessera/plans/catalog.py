"""Every registered query of the record-linkage operators, and its SQL.

Records are the parts (see :mod:`tessera.operators.records`): their names and addresses are whole
columns, a brand is a country, and a link is the same name and kind within a brand. Scores that a
matcher would give come from a hash of the pair, so that any engine gets the same ones.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tessera import session
from tessera.functions import features, text
from tessera.operators import blocking, decision, dense, fusion, lexical, metrics, model, records, splits, validate
from tessera.plans import oracles
from tessera.session import table
from tessera.sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
TOP = 20
POLICY = [("global", 0.7, 0.6), ("Brand#1", 0.6, 0.5), ("Brand#2", 0.9, 0.2)]
DEPTHS = (2, 5, 10, 15, 20, None)


class Data:
    """The frames that the queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str, recs: DataFrame | None = None) -> None:
        self.spark, self.dir = spark, sf_dir
        self.records = records.records(spark, sf_dir) if recs is None else recs
        self.queries, self.pool, self.truth = records.queries(self.records), records.pool(self.records), records.truth(self.records)
        self._kept: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame that a query reads more than once, written the first time."""
        if name not in self._kept:
            self._kept[name] = session.written(make())
        return self._kept[name]

    def structured(self, top: int = TOP) -> DataFrame:
        return blocking.structured(self.queries, self.pool, top)

    def texts(self, mode: str) -> tuple[DataFrame, DataFrame]:
        make = lambda d, i: d.select(i, "country", text.channel_text(F.col("name"), F.col("address"), mode).alias("text"))
        return make(self.queries, "qid"), make(self.pool, "tid")

    def lexical(self, mode: str = "name_only", top: int = TOP) -> DataFrame:
        return lexical.channel(*self.texts(mode), lexical.Config(max_df=0.6, top=top))

    def hits(self) -> DataFrame:
        """Both channels, each written by itself: no plan holds two searches."""
        return fusion.stack({"name_only": session.written(self.lexical()), "structured": session.written(self.structured())})

    def fused(self) -> DataFrame:
        return fusion.reciprocal_rank(self.hits())

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """The candidates of all four channels at their depths, and the channels' scores and ranks."""
        return fusion.generate_by_kind(self.queries, self.pool, blocking.duplicates(self.pool))

    def required(self) -> DataFrame:
        return self.queries.select("qid", "country")

    def scored(self) -> DataFrame:
        """qid, tid, p, country, is_match."""
        pairs = self.structured().select("qid", "tid", pair_score(F.col("qid"), F.col("tid")).alias("p")).join(self.required(), "qid")
        marked = self.truth.withColumn("hit", F.lit(1))
        return pairs.join(marked, ["qid", "tid"], "left").withColumn("is_match", F.coalesce("hit", F.lit(0))).drop("hit")

    def counts(self, ts: float = 0.7, tm: float = 0.6) -> DataFrame:
        return metrics.per_query(self.required(), self.truth, decision.two_threshold(self.scored(), ts, tm))

    def n_true(self) -> DataFrame:
        n = self.truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n_true"))
        return self.required().join(n, "qid", "left").na.fill(0, ["n_true"])


def pair_score(q: Column, t: Column) -> Column:
    """A pair's made-up probability in thousandths."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", q, t)), 1, 6), 16, 10).cast("long") % 1000) / 1000.0


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured blocking, scored by what the best matcher could make of it, by country."""
    d = Data(spark, sf_dir)
    return metrics.candidate_report(metrics.counts(d.required(), d.truth, d.structured()), ["country"])


def _on(f: Callable[[Data], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Data(spark, sf_dir))


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("qid"), "c_mktsegment", (F.col("c_custkey") % 8).alias("n_matches"))
    key = F.col("qid")
    return splits.build_splits(ids, "qid").select("qid", "split", splits.group_key(key).cast("string").alias("group_key"), splits.folds(key).alias("fold"), splits.match_bucket(F.col("n_matches")).alias("bucket"))


def _crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("qid"), (F.col("c_custkey") % 8).alias("n_matches"))
    return splits.crosstab(splits.build_splits(ids.select("qid"), "qid"), ids, "qid")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("qid"), "c_mktsegment")


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts through the primary view, and their names' core."""
    docs = table(spark, sf_dir, "documents")
    view = text.unicode_view(F.col("text"))
    return docs.select("doc_id", F.md5(view).alias("view_md5"), F.length(text.name_core(view)).alias("core_chars"), F.size(F.split(view, " ")).alias("n_tokens"))


def _scalars(d: Data) -> DataFrame:
    """String functions over all records."""
    n, a, c = F.col("business_name"), F.col("business_address"), real_country(F.col("entity_id"))
    return d.records.select(
        "entity_id", text.soundex(F.get(F.split(n, " "), F.lit(0))).alias("soundex"), text.is_missing(n).alias("missing"), text.is_blank(a).alias("blank"),
        text.expand(F.lower(a), text.STREET_WORDS["US"]).alias("expanded"), text.first_postal(a).alias("pin"), F.array_join(text.house_numbers(a), ",").alias("houses"),
        text.channel_text(n, a, "joint").alias("joint"), text.search_text(n, F.concat_ws(" ", a, F.lit("two three four five")), c).alias("search"), text.pair_text(n, a).alias("pair"), text.pair_text(n, a, F.col("country")).alias("line"),
        text.suffix_match(n, a, ("ring", "st", "bolt")).alias("suffix_match"), F.array_join(F.array_sort(features.char_grams(n)), "|").alias("grams"),
    )


def real_country(key: Column) -> Column:
    """A country with tables of its own, or one without, by an id's number."""
    names = F.array(*[F.lit(x) for x in ("US", "India", "France", "Peru")])
    return F.get(names, F.pmod(F.element_at(F.split(key, "-"), -1).cast("long"), F.lit(4)).cast("int"))


def _raw(d: Data) -> DataFrame:
    """Records as they may come: polite forms, trade names, legal forms, accents, other scripts, missing fields."""
    n, a = F.col("business_name"), F.col("business_address")
    kind = F.pmod(F.floor(F.element_at(F.split("entity_id", "-"), -1).cast("long") / 4), F.lit(8))
    written = {
        0: F.concat(n, F.lit(" Inc")), 1: F.concat(F.lit("M/s "), n, F.lit(" Pvt. Ltd.")), 2: F.concat(n, F.lit(" S.A.R.L.")), 3: F.concat(F.upper(n), F.lit(" d / b / a X & Co")),
        4: F.concat(F.replace(n, F.lit("e"), F.lit("é")), F.lit(" GmbH limited company")), 5: F.lit("-"), 6: F.concat(n, F.lit(" नाम")), 7: F.lit("!!!"),
    }
    name = F.lit("")
    for k, x in written.items():
        name = F.when(kind == k, x).otherwise(name)
    address = F.when(kind == 5, "N/A").otherwise(F.concat_ws(" ", a, F.lit("Ave Ste 9, 40012")))
    return d.records.select("entity_id", name.alias("name"), address.alias("address"), F.concat(F.lit(" "), real_country(F.col("entity_id"))).alias("country"))


def _normalized(d: Data) -> DataFrame:
    """Every view of every raw record, from the adapter that normalises an id once."""
    raw = _raw(d)
    r = text.normalized_once(raw.unionByName(raw.where(F.col("entity_id").endswith("1"))), "entity_id").select("entity_id", "rec.*")
    join = lambda c: F.array_join(c, ",")
    return r.select(
        "entity_id", "name_raw", "country_raw", "country_key", F.col("name").alias("name_view"), F.col("address").alias("address_view"), "name_latin", "address_latin", "name_core", "name_compact",
        "field_missing.name_missing", "field_missing.address_missing", "normalization_loss.unicode_empty", "normalization_loss.latin_empty",
        F.col("script.name.has_latin").alias("has_latin"), F.col("script.name.has_nonlatin").alias("has_nonlatin"), F.col("script.name.has_mark").alias("has_mark"),
        join("numbers.postal_candidates").alias("postal"), "numbers.pin_confident", join("numbers.house_tokens").alias("houses"), join("numbers.unit_tokens").alias("units"),
    )


def _loose(d: Data) -> DataFrame:
    """The other views of the raw records: search, loose and plain."""
    n, a = F.col("name"), F.col("address")
    return _raw(d).select("entity_id", text.search_ascii(F.concat(n, F.lit(".com - 123"))).alias("search"), text.loose_view(a).alias("loose"), text.plain_ascii_view(n).alias("plain"), text.latin_view(n).alias("latin"))


def _views(d: Data) -> tuple[DataFrame, DataFrame]:
    """The queries and the pool with all views of a record, written: Spark plans anew after each stage, and these expressions are large."""
    view = lambda rows, key, f: session.written(text.normalized_once(rows.withColumn("country", real_country(F.col(key))), key).withColumnRenamed("rec", f))
    return view(d.queries, "qid", "q"), view(d.pool, "tid", "t")


def _pair_features(d: Data) -> DataFrame:
    """The features without fuzzy ratios; each record is normalised once, not once a pair."""
    hits = d.hits()
    q, t = _views(d)
    best = hits.groupBy("qid", "tid").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("channels")).join(session.unsent(fusion.reciprocal_rank(hits).select("qid", "tid", "rrf")), ["qid", "tid"])
    pairs = best.join(session.unsent(q), "qid").join(session.unsent(t), "tid")
    return pairs.select("qid", "tid", *[F.round(c, 9).alias(name) for name, c in features.exact_features().items()])


def matcher_rows(d: Data) -> DataFrame:
    """Every candidate pair of the four channels with all 23 features, its label and its query's fold."""
    found, channels = d.candidates()
    scores = [F.col(f"{c}_score") for c in fusion.CHANNEL_WEIGHTS]
    count = sum((F.col(f"{c}_score").isNotNull().cast("int") for c in fusion.CHANNEL_WEIGHTS), F.lit(0))
    # a duplicate that entered at a discount was found by no channel
    lexical_best = F.greatest(*[F.coalesce(F.col(f"{c}_score"), F.lit(0.0)) for c in ("joint", "name_only", "address_only")])
    best = session.written(found.where(F.col("tid").isNotNull()).join(session.unsent(channels), ["qid", "tid"], "left").select("qid", "tid", "rrf", lexical_best.alias("score"), F.coalesce(count, F.lit(0)).alias("channels")))
    q, t = _views(d)
    # a query's pairs come last to lie together: many are of the same texts, which an Arrow batch compares once
    pairs = best.join(session.unsent(t), "tid").join(session.unsent(q), "qid")
    rows = model.label(features.pair_features(pairs), d.truth).withColumn("fold", splits.folds(F.col("qid")))
    return rows.withColumn("is_match", F.col("is_match").cast("double"))


def matcher_kinds(d: Data) -> tuple[DataFrame, DataFrame]:
    """:func:`matcher_rows` of one query of each kind, written, with ``weights``: the kind's queries in each fold. And each query's kind and fold.

    Queries that are written alike, in one country with tables of its own, have the same candidates, features and links.
    """
    named, _ = blocking.by_kind(d.queries.withColumn("own", real_country(F.col("qid"))), "qid", "own")
    named = named.select("kind", "qid", splits.folds(F.col("qid")).alias("fold"))
    first = session.written(d.records.where(F.col("source") == "S1").join(session.unsent(named.select(F.col("kind").alias("entity_id")).distinct()), "entity_id", "left_semi").select(*d.records.columns))
    one = Data(d.spark, d.dir, first.unionByName(d.records.where(F.col("source") != "S1")))
    weights = F.array(*[F.sum((F.col("fold") == k).cast("double")) for k in range(3)]).alias("weights")
    rows = matcher_rows(one).drop("fold").withColumnRenamed("qid", "kind")
    return session.written(rows.join(session.unsent(named.groupBy("kind").agg(weights)), "kind")), named


def _fuzzy(d: Data) -> DataFrame:
    """Fuzzy ratios of the structured pairs, once a distinct pair of names and of addresses."""
    pairs = d.structured().join(d.queries.select("qid", F.col("name").alias("a"), F.col("address").alias("x")), "qid").join(d.pool.select("tid", F.col("name").alias("b"), F.col("address").alias("y")), "tid")
    q, t = F.struct(F.col("a").alias("name"), F.col("x").alias("address")).alias("q"), F.struct(F.col("b").alias("name"), F.col("y").alias("address")).alias("t")
    return pairs.select("qid", "tid", q, t).select("qid", "tid", *[F.round(c, 9).alias(n) for n, c in features.fuzzy_features().items()])


def _merged(d: Data) -> DataFrame:
    """The earlier feature set without fuzzy ratios, of the lexical pairs."""
    other = d.pool.select("tid", F.col("name").alias("other_name"), F.col("address").alias("other_address"), F.col("country").alias("other_country"))
    pairs = d.lexical().join(session.unsent(d.queries), "qid").join(session.unsent(other), "tid")
    return pairs.select("qid", "tid", *[F.round(c, 9).alias(n) for n, c in features.merged_exact().items()])


def _fusion_weights(d: Data) -> DataFrame:
    scored = d.scored().withColumn("cosine", pair_score(F.col("tid"), F.col("qid")))
    return decision.sweep_fusion(scored, d.n_true(), d.spark.createDataFrame(POLICY, "grp string, ts double, tm double"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id divides by 50, against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return dense.search(asked, v.select(F.col("vec_id").alias("tid"), F.col("embedding").alias("v")), 10).select("qid", "tid", F.round("score", 4).alias("score"), "rank")


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 8 tokens of 8 numbers, the even ones under the mask."""
    v = table(spark, sf_dir, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i % 2 == 0).cast("int"))
    pooled = dense.mean_pool(tokens, mask)
    return v.select("vec_id", *[F.round(F.get(pooled, F.lit(i)), 6).alias(f"p{i}") for i in range(8)])


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of each vector with the next of its label, and a fusion with a made-up score."""
    v = table(spark, sf_dir, "embeddings")
    w = W.partitionBy("label").orderBy("vec_id")
    near = v.withColumn("other", F.lead("embedding").over(w)).where(F.col("other").isNotNull())
    cos = features.cosine(F.col("embedding"), F.col("other"))
    return near.select("vec_id", F.round(cos, 5).alias("cosine"), F.round(features.fused(F.lit(0.5), cos, 0.2), 5).alias("fused"))


def _hashed(d: Data) -> DataFrame:
    q, p = d.texts("name_only")
    return dense.hashed_search(dense.hashed_grams(q, "qid"), dense.hashed_grams(p, "tid"), 10)


def _lists(d: Data) -> DataFrame:
    """The sorted and the ranked id list of each query, and its count by commas."""
    hits = d.structured()
    a = sinks.id_lists(d.required(), hits)
    b = sinks.ranked_id_lists(d.required(), hits).withColumnRenamed("ids", "ranked")
    return a.join(b, "qid").select("qid", "ids", "ranked", tables.id_count(F.col("ids")).cast("long").alias("n"), F.size(tables.id_list(F.col("ids"))).cast("long").alias("n_items"))


def _validator(d: Data) -> DataFrame:
    """The matches of every query against the candidates, the truth and the pool: findings by rule."""
    lists = sinks.id_lists(d.required(), d.structured(5))
    lines = lists.select(F.lit(1).alias("line_no"), F.concat_ws("\t", "qid", "ids").alias("value")).unionByName(d.spark.createDataFrame([(0, "source1_entity_id\tmatched_entity_ids")], "line_no int, value string"))
    other = d.required().where(~F.col("qid").endswith("7")).unionByName(d.spark.createDataFrame([("S1-x", "none")], "qid string, country string"))
    return validate.check_lists(lines, "source1_entity_id\tmatched_entity_ids", other, d.pool.where(~F.col("tid").endswith("3"))).select("rule", "n", F.array_join("examples", ",").alias("examples"))


def _pairs_check(d: Data) -> DataFrame:
    scored = d.scored().withColumn("is_match", F.when(F.col("tid").endswith("11"), 1 - F.col("is_match")).otherwise(F.col("is_match")))
    return validate.check_pairs(scored, d.truth, d.required().where(~F.col("qid").endswith("9"))).select("rule", "n", F.array_join("examples", ",").alias("examples"))


def _chunks(d: Data) -> DataFrame:
    all_ = d.required().withColumn("chunk", F.length("country") % 2)
    twice = all_.where(F.col("qid").endswith("1")).withColumn("chunk", F.lit(9))
    return validate.check_chunks(all_.where(~F.col("qid").endswith("4")).unionByName(twice), d.required().where(~F.col("qid").endswith("6"))).select("rule", "n", F.array_join("examples", ",").alias("examples"))


def _sweep(d: Data, ordered: bool = True) -> DataFrame:
    cells = decision.grid(d.spark, decision.SINGLETON_GRID, decision.MATCH_GRID, ordered)
    return decision.sweep(d.scored(), d.n_true(), cells)


def _policies(d: Data) -> DataFrame:
    return decision.select_policies(d.scored(), d.n_true(), decision.grid(d.spark, decision.POLICY_GRID, decision.POLICY_GRID))


def _free(d: Data) -> DataFrame:
    cells = decision.grid(d.spark, decision.FREE_GRID, decision.FREE_GRID, ordered=False)
    return decision.best_cell(decision.sweep(d.scored(), d.n_true(), cells), prefer_high=True)


def _applied(d: Data) -> DataFrame:
    policy = d.spark.createDataFrame(POLICY, "grp string, ts double, tm double")
    return decision.apply_policy(d.scored(), policy).select("qid", "tid", "p", "country")


def _oracle_scores(d: Data) -> DataFrame:
    return metrics.per_query(d.required(), d.truth, metrics.oracle(d.truth, d.structured()))


def _bootstrap(d: Data) -> DataFrame:
    out = metrics.paired_bootstrap(d.counts(0.7, 0.7), d.counts(0.6, 0.5), 1000, 0, "country")
    return d.spark.createDataFrame([tuple(out.values())], "delta double, low double, high double")


#: Settings for tables as small as the samples; the baseline's leaves hold 80 pairs.
SMALL = {"maxDepth": 4, "stepSize": 0.2, "minInstancesPerNode": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}


def _model(d: Data) -> DataFrame:
    """Out-of-fold predictions of all candidate pairs from the 23 features, three folds by query."""
    rows, named = matcher_kinds(d)
    out, _, _ = model.out_of_fold(rows, features.FEATURES, rounds=8, settings=SMALL)
    scored = out.select("kind", "tid", "fold", "is_match", "p")
    return named.join(session.unsent(scored), ["kind", "fold"]).select("qid", "tid", "fold", "is_match", "p")


def _reloaded(d: Data) -> DataFrame:
    """Saved and loaded, the model refitted on all rows predicts as before: pairs, and how many differ."""
    rows = matcher_kinds(d)[0].withColumn("weight", model.total_weight()).drop("weights")
    made, path = model.refit(rows, features.FEATURES, [3, 5], settings=SMALL), session.folder(d.spark)
    model.save(made, features.FEATURES, path, rounds=4)
    again, names, notes = model.load(path, features.FEATURES)
    both = model.predict(again, model.predict(made, rows, features.FEATURES).withColumnRenamed("p", "before"), names)
    n_pairs, n_differ = F.sum("weight"), F.sum(F.when(F.col("before").eqNullSafe(F.col("p")), 0.0).otherwise(F.col("weight")))
    return both.agg(n_pairs.cast("long").alias("n_pairs"), n_differ.cast("long").alias("n_differ")).withColumn("n_features", F.lit(len(names))).withColumn("rounds", F.lit(notes["rounds"]))


def _screen(d: Data) -> DataFrame:
    """Out-of-fold predictions of four settings over the same candidates: pairs and queries of each, written: no plan holds two settings."""
    rows, _ = matcher_kinds(d)
    arms = {f"depth-{k}": {**SMALL, "maxDepth": k} for k in (1, 2, 3, 4)}
    bad = F.when(F.col("p").between(0, 1), 0.0).otherwise(F.col("weight"))
    out = None
    for name, scored in model.screen(rows, features.FEATURES, arms).items():
        pairs = scored.groupBy("kind", "fold", "tid").agg(F.sum("weight").alias("n"), F.max("weight").alias("n_pairs"), F.sum(bad).alias("n_bad"))
        part = session.written(pairs.agg(F.lit(name).alias("arm"), *[F.sum(c).cast("long").alias(c) for c in ("n", "n_pairs", "n_bad")]))
        out = part if out is None else out.unionByName(part)
    return out


def _hard_negatives(d: Data) -> DataFrame:
    return model.hard_negatives(d.scored()).select("qid", "tid", "p")


def _reranked(d: Data) -> DataFrame:
    return model.rerank(d.scored(), lambda rows: rows.withColumn("p2", F.round(1 - F.col("p"), 6)), 4).select("qid", "tid", "p", "p2")


def _basic_score(d: Data) -> DataFrame:
    """The plain matcher's score of the structured pairs, its ratio by a function that SQL has too."""
    other = d.pool.select("tid", F.col("name").alias("b"), F.col("address").alias("y"))
    pairs = d.structured(5).join(d.queries.select("qid", F.col("name").alias("a"), F.col("address").alias("x")), "qid").join(other, "tid")
    pin = lambda c: F.lpad(F.regexp_extract(c, r"^(\d+)", 1), 6, "5")
    score = features.basic_score(F.col("a"), F.col("b"), pin(F.col("x")), pin(F.col("y")), likeness)
    return pairs.select("qid", "tid", F.round(score, 6).alias("score")).where("score >= 0.5")


def likeness(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length: a ratio that any engine has."""
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 6)


def _backfill(d: Data) -> DataFrame:
    with_text = lambda rows: rows.withColumn("text", F.concat_ws(" ", "name", "address"))
    found = d.once("few", lambda: d.structured(5))
    weak = lexical.weak(d.queries, found, 10, low=3.0)
    return blocking.backfill(with_text(d.queries), with_text(d.pool), found, weak, likeness, least=0.5)


def _sharded(d: Data) -> DataFrame:
    """The lexical search with its settings by country, over search texts."""
    named = lambda rows, key: rows.withColumn("country", real_country(F.col(key))).select(key, "country", text.search_text(F.col("name"), F.col("address"), F.col("country")).alias("text"))
    few = {k: dataclasses.replace(c, top=c.top // 10) for k, c in lexical.BY_COUNTRY.items()}
    return lexical.channel(named(d.queries, "qid"), named(d.pool, "tid"), few)


def _gated(d: Data) -> DataFrame:
    """The second pass of the queries of one country."""
    asked, pool = d.texts("name_only")
    config = lexical.Config(max_df=0.6, top=TOP)
    return lexical.second_pass(asked, pool, d.once("strong", lambda: d.lexical().where(F.col("score") > 0.5)), config, country="Brand#7")


def _tsv(d: Data) -> DataFrame:
    """Records through a tab-separated file and back, the first 500 by id."""
    path = session.folder(d.spark)
    d.records.select(*tables.RECORD.fieldNames()).write.option("sep", "\t").option("header", True).option("escape", '"').csv(path)
    return tables.capped(tables.tsv(d.spark, path), "entity_id", 500)


def _truth_file(d: Data, held: bool = False) -> DataFrame:
    """The truth through its file and back; with ``held``, of the ids that the exposure hash selects."""
    path = session.folder(d.spark)
    sinks.write_lists(sinks.id_lists(d.required(), d.truth), path, "matched_entity_ids")
    back = tables.held_truth(d.spark, path) if held else tables.id_lists(d.spark, path, "matched_entity_ids")
    return back.select("qid", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"))


def _manifest(d: Data) -> DataFrame:
    path = session.folder(d.spark)
    d.required().agg(F.to_json(F.struct(F.array_sort(F.collect_list("qid")).alias("query_ids"), F.lit("x").alias("seed"))).alias("value")).write.text(path)
    return tables.manifest(d.spark, path)


def _bundle(d: Data) -> DataFrame:
    path = session.folder(d.spark)
    for part, rows in (("train", d.required().where(~F.col("qid").endswith("3"))), ("eval", d.required().where(F.col("qid").endswith("3")))):
        rows.write.parquet(f"{path}/{part}.parquet")
    return tables.bundle(d.spark, path)


def _merged_chunks(d: Data) -> DataFrame:
    path = session.folder(d.spark)
    sinks.write_chunks(sinks.id_lists(d.required(), d.structured(5)).join(d.required(), "qid").withColumn("chunk", F.conv(F.substring(F.md5("qid"), 1, 4), 16, 10).cast("long") % 4), path)
    return sinks.merge_chunks(d.spark, path, d.required()).select("qid", "ids", F.col("country").cast("string").alias("country"), F.col("chunk").cast("long").alias("chunk"))


def _sink(d: Data, write: Callable[[DataFrame, str], None], rows: DataFrame) -> DataFrame:
    path = session.folder(d.spark)
    write(rows, path)
    return d.spark.read.parquet(path)


def _outputs(d: Data) -> DataFrame:
    lists = lambda hits: hits.groupBy("qid").agg(F.array_sort(F.collect_list("tid")).alias("ids"))
    hits = d.once("eight", lambda: d.structured(8))
    known = d.pool.where(~F.col("tid").endswith("3"))
    return validate.check_outputs(lists(hits), lists(hits.where(F.col("rank") <= 5)), d.required().where(~F.col("qid").endswith("7")), known).select("rule", "n", F.array_join("examples", ",").alias("examples"))


def _invariants(d: Data) -> DataFrame:
    one = metrics.summarize(d.counts()).where(F.col("country").isNotNull())
    other = one.withColumn("macro_f05", F.col("macro_f05") + F.when(F.col("country") == "Brand#3", 0.5).otherwise(1e-9)).where(F.col("country") != "Brand#9")
    return validate.invariants(one, other, ["country"]).select("metric", "n", "n_off")


def _negatives(d: Data) -> DataFrame:
    return splits.negatives(d.structured().select("qid", "tid"), d.truth)


def _subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles with a screen within the comparison, and what breaks the rules of both."""
    all_ = splits.subset_role(_roles(spark, sf_dir), "qid", "screen", "comparison", 7, "c_mktsegment")
    broken = splits.overlaps(all_, "qid", ["screen"]).select("qid").unionByName(splits.outside_role(all_, "qid", "screen", "comparison"))
    return all_.where(F.col("role") == "screen").select("qid", "c_mktsegment", "role").unionByName(broken.select("qid", F.lit("").alias("c_mktsegment"), F.lit("broken").alias("role")))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.roles(_customers(spark, sf_dir), "qid", {"calibration": 20, "comparison": 30}, "c_mktsegment").select("qid", "c_mktsegment", "role")


QUERIES: dict[str, Query] = {
    "flagship": flagship,
    "pool_scan": lambda s, d: records.pool_from(*[records.records(s, d).where(F.col("source") == x) for x in ("S2", "S3")], country="Brand#7").select("entity_id", "business_name", "business_address"),
    "structured_keys": _on(lambda d: blocking.keys(d.pool, "tid").select("tid", "country", "key_type", "key")),
    "structured_overflow": _on(lambda d: blocking.overflow(blocking.keys(d.pool.withColumn("country", F.lit("all")), "tid"))),
    "structured_search": _on(lambda d: d.structured()),
    "pin_block": _on(lambda d: blocking.pin_block(*[x.withColumn("address", F.concat(F.lit("zip 400"), F.lpad(F.regexp_extract("address", r"^(\d+)", 1), 3, "0"))) for x in (d.queries, d.pool)], 40)),
    "backfill": _on(_backfill),
    "lexical_by_country": _on(_sharded),
    "second_pass_gated": _on(_gated),
    "candidates": _on(lambda d: d.candidates()[0].select("qid", "tid", "rrf", "rrf_rank")),
    "candidate_lookups": _on(lambda d: d.candidates()[1]),
    "challenger": _on(lambda d: fusion.reciprocal_rank(fusion.stack({"structured": session.written(blocking.structured(d.queries, d.pool, 100, ("small", "red"))), "locked": session.written(d.lexical())}), None, from_zero=True).where(F.col("rrf_rank") <= 50)),
    "duplicate_map": _on(lambda d: blocking.duplicates(d.pool).select("tid", F.array_join("siblings", ",").alias("siblings"))),
    "missed_targets": _on(lambda d: blocking.missed_targets(d.truth, d.structured(1))),
    "lexical_name": _on(lambda d: d.lexical()),
    "lexical_address": _on(lambda d: d.lexical("address_only")),
    "second_pass": _on(lambda d: lexical.second_pass(*d.texts("name_only"), d.lexical().where(F.col("score") > 0.5), lexical.Config(max_df=0.6, top=TOP))),
    "dense_search": _dense,
    "mean_pooling": _pooled,
    "pair_cosine": _cosine,
    "hashed_search": _on(_hashed),
    "fusion_sources": _on(lambda d: fusion.union_with_sources(d.hits()).select("qid", "tid", F.array_join(F.array_sort(F.transform(F.map_entries("sources"), lambda e: F.concat_ws(":", e["key"], F.format_string("%.6f", e["value"]["score"]), e["value"]["rank"]))), ",").alias("channels"))),
    "fusion_rrf": _on(lambda d: d.fused()),
    "fusion_rrf_plain": _on(lambda d: fusion.reciprocal_rank(d.hits(), None)),
    "fusion_lookups": _on(lambda d: fusion.lookups(d.hits(), ("name_only", "structured"))),
    "fusion_duplicates": _on(lambda d: fusion.expand_duplicates(d.once("fused", d.fused), blocking.duplicates(d.pool))),
    "fusion_cover": _on(lambda d: fusion.cover(d.fused(), d.required(), 10)),
    "fusion_unions": _on(lambda d: fusion.cumulative_sizes({"name_only": d.once("lexical", d.lexical), "structured": d.once("structured", d.structured)}, blocking.duplicates(d.pool))),
    "fusion_max_merge": _on(lambda d: fusion.max_merge(d.lexical(), d.structured())),
    "fusion_owner": _on(lambda d: fusion.one_owner(d.structured()).select("qid", "tid", "score")),
    "fusion_hash": _on(lambda d: fusion.set_hash(d.structured(), "score")),
    "union_sizes": _on(lambda d: d.hits().select("qid", "tid").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"))),
    "normalize_documents": _normalize,
    "string_functions": _on(_scalars),
    "normalized_records": _on(_normalized),
    "other_views": _on(_loose),
    "pair_features": _on(_pair_features),
    "fuzzy_features": _on(_fuzzy),
    "merged_features": _on(_merged),
    "splits": _splits,
    "split_crosstab": _crosstab,
    "fresh_probe": lambda s, d: splits.sample(_customers(s, d).where(~splits.exposed(F.col("qid"))), "qid", 25, "probe").select("qid"),
    "group_sample": lambda s, d: splits.sample(_customers(s, d), "qid", 10, "sample", ["c_mktsegment"]),
    "sorted_slice": lambda s, d: splits.slice_sorted(_customers(s, d), "qid", 10, 15),
    "role_manifest": _roles,
    "role_subsets": _subsets,
    "role_checks": lambda s, d: splits.overlaps(_roles(s, d), "qid").select("qid").unionByName(splits.uncovered(_customers(s, d), _roles(s, d), "qid")),
    "negative_sample": _on(_negatives),
    "two_threshold": _on(lambda d: decision.two_threshold(d.scored(), 0.7, 0.6).select("qid", "tid", "p")),
    "single_threshold": _on(lambda d: decision.single_threshold(d.scored(), 0.5).select("qid", "tid", "p")),
    "sweep_diagonal": _on(lambda d: decision.sweep(d.scored(), d.n_true(), d.spark.createDataFrame([(x, x) for x in decision.DIAGONAL], "ts double, tm double"))),
    "sweep_grid": _on(_sweep),
    "tune_best": _on(lambda d: decision.best_cell(_sweep(d))),
    "tune_free": _on(_free),
    "select_policies": _on(_policies),
    "apply_policy": _on(_applied),
    "fusion_weights": _on(_fusion_weights),
    "per_query_scores": _on(lambda d: d.counts().select("qid", "country", "n_true", "n_pred", "n_tp", F.round("f05", 9).alias("f05"), F.round(metrics.f05_by_rates(F.col("n_true"), F.col("n_pred"), F.col("n_tp")), 9).alias("f05_by_rates"))),
    "summary": _on(lambda d: metrics.summarize(d.counts())),
    "losses": _on(lambda d: metrics.losses(d.counts(), _oracle_scores(d), ["country"])),
    "singletons": _on(lambda d: metrics.singletons(d.counts(), ["country"])),
    "error_report": _on(lambda d: metrics.error_report(d.counts())),
    "micro_scores": _on(lambda d: metrics.micro(d.counts())),
    "slices": _on(lambda d: metrics.slices(d.counts(), {"everyone": F.lit(True), "exposed": splits.exposed(F.col("qid")), "fresh": ~splits.exposed(F.col("qid"))})),
    "recall_in_pool": _on(lambda d: metrics.recall_in_pool(d.truth, d.pool.where(~F.col("tid").endswith("5")), d.structured(), 10)),
    "recall_gates": _on(lambda d: metrics.recall_gates(metrics.counts(d.required(), d.truth, d.structured()))),
    "hit_samples": _on(lambda d: metrics.hit_samples(d.truth, d.structured(5), d.required())),
    "depth_frontier": _on(lambda d: metrics.depth_frontier(d.required(), d.truth, d.fused(), DEPTHS)),
    "match_histogram": _on(lambda d: d.n_true().groupBy(splits.match_bucket(F.col("n_true")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))),
    "score_summary": _on(lambda d: d.scored().groupBy("is_match").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.min("p").alias("least"), F.max("p").alias("most"), F.round(F.percentile("p", 0.5), 6).alias("median"))),
    "bootstrap": _on(lambda d: metrics.resampled(d.counts(0.7, 0.7), d.counts(0.6, 0.5), by="country")),
    "bootstrap_plain": _on(lambda d: metrics.resampled(d.counts(0.7, 0.7), d.counts(0.6, 0.5))),
    "bootstrap_binned": _on(_bootstrap),
    "id_lists": _on(_lists),
    "validator": _on(_validator),
    "validate_pairs": _on(_pairs_check),
    "validate_chunks": _on(_chunks),
    "outside_candidates": _on(lambda d: validate.outside(d.structured(), d.lexical())),
    "bundle_parity": _on(lambda d: validate.parity(d.scored(), d.scored().where(F.col("is_match") == 1))),
    "out_of_fold": _on(_model),
    "model_reload": _on(_reloaded),
    "model_screen": _on(_screen),
    "hard_negatives": _on(_hard_negatives),
    "rerank": _on(_reranked),
    "basic_score": _on(_basic_score),
    "tsv_records": _on(_tsv),
    "truth_file": _on(_truth_file),
    "held_truth": _on(lambda d: _truth_file(d, held=True)),
    "manifest": _on(_manifest),
    "bundle": _on(_bundle),
    "merged_chunks": _on(_merged_chunks),
    "predictions_sink": _on(lambda d: _sink(d, sinks.write_predictions, d.scored().select("qid", "tid", "p"))),
    "scores_sink": _on(lambda d: _sink(d, sinks.write_scores, d.counts().select("qid", "n_true", "n_pred", "n_tp"))),
    "check_outputs": _on(_outputs),
    "invariants": _on(_invariants),
}

ORACLES: dict[str, str] = oracles.ORACLES
