"""Literal cases of the operators."""

import json
import os
import random
import re
import time
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from tessera import session
from tessera.functions import features, fuzzy, text
from tessera.operators import blocking, decision, dense, fusion, lexical, metrics, model, products, records, splits, validate
from tessera.plans import catalog
from tessera.sources import sinks, tables
from tessera.streaming import microbatch


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).collect()[0]["x"]


def frame(spark, pairs, names="qid string, tid string"):
    return spark.createDataFrame(pairs, names)


def score(n_true, n_pred, n_tp):
    return (1.0 if not n_pred else 0.0) if not n_true else 0.0 if not n_pred else 5 * n_tp / (n_true + 4 * n_pred)


@pytest.mark.parametrize(("truth", "pred", "want"), [("ab", "abc", 10 / 14), ("", "", 1.0), ("", "x", 0.0), ("x", "", 0.0), ("a", "ab", 5 / 9), ("ab", "ab", 1.0)])
def test_f05(spark, truth, pred, want):
    asked = frame(spark, [("Q",)], "qid string")
    make = lambda s: frame(spark, [("Q", x) for x in s])
    row = metrics.per_query(asked, make(truth), make(pred)).collect()[0]
    assert row["f05"] == pytest.approx(want)


def test_macro_and_oracle(spark):
    asked = frame(spark, [("Q1",), ("Q2",), ("Q3",)], "qid string")
    truth = frame(spark, [("Q1", "T1"), ("Q3", "T2"), ("Q3", "T3")])
    pred = truth.unionByName(frame(spark, [("Q2", "T99")]))
    assert metrics.macro(metrics.per_query(asked, truth, pred)) == pytest.approx(2 / 3)
    asked, truth = frame(spark, [("Q1",), ("Q2",)], "qid string"), frame(spark, [("Q1", "T1"), ("Q1", "T2")])
    best = metrics.oracle(truth, frame(spark, [("Q1", "T1"), ("Q1", "T99")]))
    assert metrics.macro(metrics.per_query(asked, truth, best)) == pytest.approx(11 / 12)
    with pytest.raises(ValueError):
        metrics.macro(metrics.per_query(asked.limit(0), truth, best))


def hits(spark):
    rows = [("joint", "Q1", "T1", 0.9, 1), ("joint", "Q1", "T2", 0.8, 2), ("joint", "Q2", "T3", 0.7, 1), ("name_only", "Q1", "T2", 0.9, 1), ("name_only", "Q1", "T4", 0.5, 2), ("name_only", "Q2", "T3", 0.4, 1)]
    return spark.createDataFrame(rows, "channel string, qid string, tid string, score double, rank int")


def test_reciprocal_rank(spark):
    got = [(r["tid"], round(r["rrf"], 9)) for r in fusion.reciprocal_rank(hits(spark)).where("qid = 'Q1'").orderBy("rrf_rank").collect()]
    assert got == [("T2", 0.032469593), ("T1", 0.019672131), ("T4", 0.012903226)]
    a, b = (fusion.set_hash(fusion.reciprocal_rank(hits(spark).repartition(n))).orderBy("qid").collect() for n in (1, 3))
    assert a == b


def test_duplicates_enter_at_a_discount(spark):
    ranking = spark.createDataFrame([("Q1", "T1", 0.03)], "qid string, tid string, rrf double")
    siblings = spark.createDataFrame([("T1", ["T1_clone"])], "tid string, siblings array<string>")
    got = fusion.expand_duplicates(ranking, siblings).orderBy("rrf_rank").collect()
    assert [(r["tid"], round(r["rrf"], 9)) for r in got] == [("T1", 0.03), ("T1_clone", 0.0297)]


def test_duplicates_of_many_parents_enter_once(spark):
    """A class is taken in once a query, ids may repeat or be in two classes, and a bound on the list is a cut of the whole list."""
    rng = random.Random(7)
    pool = [(f"T{i:02}", rng.choice("abc"), rng.choice("xy")) for i in range(40)] + [("T03", "a", "x"), ("T03", "b", "y"), ("T05", "c", "x"), ("T99", " ", "x")]
    siblings = blocking.duplicates(spark.createDataFrame(pool, "tid string, name string, address string"))
    lists = {q: rng.sample([f"T{i:02}" for i in range(40)] + ["T99"], n) for q, n in (("Q1", 1), ("Q2", 6), ("Q3", 30))}
    ranking = spark.createDataFrame([(q, t, 1 / (60 + i), i) for q, ts in lists.items() for i, t in enumerate(ts, 1)], "qid string, tid string, rrf double, rrf_rank int")
    want = []
    for q, ts in lists.items():
        own = {t: 1 / (60 + i) for i, t in enumerate(ts, 1)}
        more = {}
        for r in siblings.collect():
            for s in r["siblings"] if r["tid"] in own else ():
                more[s] = max(more.get(s, 0.0), own[r["tid"]])
        own |= {s: round(0.99 * x, 12) for s, x in more.items() if s not in own}
        want += [(q, t, round(x, 12), i) for i, (t, x) in enumerate(sorted(own.items(), key=lambda y: (-y[1], y[0])), 1)]
    plain = lambda df: sorted((r["qid"], r["tid"], round(r["rrf"], 12), r["rrf_rank"]) for r in df.collect())
    assert plain(fusion.expand_duplicates(ranking, siblings)) == sorted(want)
    for n in (1, 4, 12):
        assert plain(fusion.expand_duplicates(ranking, siblings, top=n)) == sorted(r for r in want if r[3] <= n)
    taken = fusion._with_duplicates(ranking, siblings).groupBy("qid").count().collect()
    assert all(r["count"] <= len(pool) for r in taken)


def test_policy(spark):
    scored = spark.createDataFrame([("a", "x", 0.9, "US"), ("a", "y", 0.65, "US"), ("b", "z", 0.65, "India"), ("c", "w", 0.62, "US")], "qid string, tid string, p double, country string")
    policy = spark.createDataFrame([("global", 0.70, 0.67), ("US", 0.60, 0.60)], "grp string, ts double, tm double")
    assert {(r["qid"], r["tid"]) for r in decision.apply_policy(scored, policy).collect()} == {("a", "x"), ("a", "y"), ("c", "w")}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 6), st.integers(0, 10), st.integers(0, 1)), max_size=12))
def test_sweep_is_the_scalar_rule(spark, rows):
    rows = [(q, str(t), p / 10, m) for (q, t), (p, m) in {(q, t): (p, m) for q, t, p, m in rows}.items()]
    scored = spark.createDataFrame(rows, "qid string, tid string, p double, is_match int")
    n_true = {q: sum(m for a, _, _, m in rows if a == q) for q in "abc"}
    truth = spark.createDataFrame(list(n_true.items()), "qid string, n_true long")
    cells = [(0.5, 0.5), (0.7, 0.3), (0.9, 0.1)]
    got = {(r["ts"], r["tm"]): r["macro_f05"] for r in decision.sweep(scored, truth, spark.createDataFrame(cells, "ts double, tm double")).collect()}
    for ts, tm in cells:
        total = 0.0
        for q in "abc":
            own = [(p, m) for a, _, p, m in rows if a == q]
            kept = [m for p, m in own if p >= tm] if own and max(p for p, _ in own) >= ts else []
            total += score(n_true[q], len(kept), sum(kept))
        assert got[ts, tm] == pytest.approx(total / 3, abs=1e-8)


@pytest.mark.parametrize("raw", ["हिन्दी नाम", "தமிழ் பெயர்", "Café Société"])
def test_scripts_survive(spark, raw):
    got = one(spark, text.unicode_view(F.col("s")), s=raw)
    assert got and all(c.isalnum() or c == " " or __import__("unicodedata").category(c)[0] == "M" for c in got)


def test_normalisation(spark):
    view = lambda name, address, country: one(spark, text.normalized(F.col("n"), F.col("a"), F.col("c")), n=name, a=address, c=country)
    r = view("Starbucks Coffee LLC", "123 Main St Ste 400", "US")
    assert r["name_core"] == "starbucks coffee" and "123" in r["numbers"]["house_tokens"] and r["numbers"]["unit_tokens"] == ["400"] and "suite" in r["address"]
    assert "societe" in view("Ste Dupont", "", "France")["name"]
    empty = view("", "", "US")
    assert empty["field_missing"]["name_missing"] and not empty["normalization_loss"]["unicode_empty"]
    assert "societe responsabilite limitee dupont" in view("S.A.R.L. Dupont", "", "France")["name"]
    assert "reliance industries private limited" in view("M/s Reliance Industries Pvt. Ltd.", "", "India")["name"]
    assert one(spark, text.first_postal(F.col("s")), s="12 Rue de la Paix, 75002 Paris") == "75002"
    assert one(spark, text.first_postal(F.col("s")), s="Wadala, Mumbai 400031") == "400031"
    assert one(spark, text.search_ascii(F.col("s")), s="Ho1y Ministries - 1535566039") == "holy ministries"
    assert one(spark, text.search_ascii(F.col("s")), s="quinlandentalassociates.com") == "quinlandentalassociates"
    assert one(spark, text.unicode_view(F.col("s")), s="Straße & Co") == "strasse and co"
    assert one(spark, text.loose_view(F.col("s")), s="Acme, Inc. (Rd)") == "acme incorporated road"
    assert one(spark, text.plain_ascii_view(F.col("s")), s="Société Ltd.") == "societe limited"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("d / b / a", "dba"), ("head/b/adam", "head b adam"), ("smith d/b/a acme", "smith dba acme"), ("M / s. Foo", "foo"), ("a.b.c. inc", "abc inc"), ("x\u00a0y", "x y"), ("d/b/a", "dba")],
)
def test_primary_view(spark, raw, want):
    assert one(spark, text.unicode_view(F.col("s")), s=raw) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("acme private limited", "acme"), ("private limited", ""), ("acme limited liability company", "acme"), ("x societe responsabilite limitee", "x"), ("a liability company", "a liability"),
        ("acme societe", "acme"), ("", ""), ("societe responsabilite", "societe responsabilite"), ("limited acme", "limited acme"), ("acme " + "limited company " * 10_000 + "gmbh", "acme"),
    ],
)
def test_name_core(spark, name, want):
    assert one(spark, text.name_core(F.col("s")), s=name) == want


@pytest.mark.parametrize(
    ("name", "unicode_empty", "latin_empty", "missing"), [("-", False, False, True), ("!!!", True, False, False), ("", False, False, True), ("नमस्ते", False, True, False), ("Café", False, False, False), ("\tNA ", False, False, True)]
)
def test_losses(spark, name, unicode_empty, latin_empty, missing):
    r = one(spark, text.normalized(F.col("n"), F.col("a"), F.col("c")), n=name, a="x", c=" US")
    assert (r["normalization_loss"]["unicode_empty"], r["normalization_loss"]["latin_empty"], r["field_missing"]["name_missing"]) == (unicode_empty, latin_empty, missing)
    assert (r["country_raw"], r["country_key"]) == (" US", "US") and one(spark, text.country_key(F.col("s")), s="  ") == "__default__"


def test_normalised_once(spark):
    rows = spark.createDataFrame([("a", "Acme Ltd", "1 Rd", "India"), ("a", "Acme Ltd", "1 Rd", "India"), ("b", None, None, None)], "id string, name string, address string, country string")
    got = {r["id"]: r["rec"] for r in text.normalized_once(rows, "id").collect()}
    assert got["a"]["name"] == "acme limited" and got["a"]["address"] == "1 road" and got["b"]["name"] == "" and got["b"]["field_missing"]["name_missing"]


def brute_top(q, p, top, least):
    out = []
    for i, a in q.items():
        norm = lambda v: sum(x * x for x in v.values()) ** 0.5
        scores = sorted(((-round(sum(w * b.get(g, 0) for g, w in a.items()) / norm(a) / norm(b), 6), j) for j, b in p.items()))
        out += [(i, j, -s, n) for n, (s, j) in enumerate([x for x in scores if -x[0] > least][:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("pool_block", "query_block", "step"), [(1000, 1000, 1 << 22), (7, 5, 40)])
def test_sparse_products(spark, monkeypatch, pool_block, query_block, step):
    monkeypatch.setattr(products, "STEP", step)
    rng = random.Random(2)
    make = lambda n, c: {f"{c}{i:02}": {rng.randint(0, 30): float(rng.randint(1, 3)) for _ in range(rng.randint(1, 6))} for i in range(n)}
    q, p = make(23, "q"), make(40, "t")
    frame = lambda d, key: spark.createDataFrame([("s", i, [(g, w) for g, w in v.items()]) for i, v in d.items()], f"shard string, {key} string, v array<struct<g: long, w: double>>")
    got = products.sparse(frame(q, "qid"), frame(p, "tid"), 4, 0.1, pool_block, query_block)
    assert sorted((r["qid"], r["tid"], r["score"], r["rank"]) for r in got.collect()) == brute_top(q, p, 4, 0.1)
    assert products.sparse(frame(q, "qid"), frame(p, "tid").limit(0), 4).count() == 0


def test_texts_are_searched_once(spark, monkeypatch):
    """Equal texts share a search, and a query still gets the records that a search of every record gives."""
    rng = random.Random(5)
    texts = ["red bolt", "red ring", "blue bolt", "blue ring", "old plate"]
    make = lambda n, c: [(f"{c}{i:03}", rng.choice("XY"), rng.choice(texts)) for i in range(n)]
    q, p = make(60, "q"), [*make(200, "t"), ("t900", "X", "red"), ("t900", "X", "bolt"), ("t901", "Y", None)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} string, country string, text string")
    searched, sparse = [], products.sparse
    monkeypatch.setattr(products, "sparse", lambda a, b, *more: searched.append((a.count(), b.count())) or sparse(a, b, *more))
    config = lexical.Config(min_df=1, max_df=1.0, top=7, threshold=0.1)
    got = sorted(map(tuple, lexical.channel(frame(q, "qid"), frame(p, "tid"), config).collect()))

    asked, pool = (lexical.counts(frame(x, k), k, config.grams).withColumn("copies", F.lit(1)) for x, k in ((q, "qid"), (p, "tid")))
    model = lexical.fit(pool, frame(p, "tid"), config)
    bag = lambda rows, key: {(r["shard"], r[key]): {e["g"]: e["w"] for e in r["v"]} for r in lexical.vectors(rows, key, model).collect()}
    a, b, want = bag(asked, "qid"), bag(pool, "tid"), []
    for c in "XY":
        want += brute_top({k: v for (s, k), v in a.items() if s == c}, {k: v for (s, k), v in b.items() if s == c}, 7, 0.1)
    assert got == sorted(want)
    assert searched == [(len({x[1:] for x in q}), len({x[1:] for x in p[:200]}) + 1)]


def test_records_written_alike_are_searched_once(spark, monkeypatch):
    """One record of a kind is joined on keys, and each query still gets what a search of every record gives."""
    rng = random.Random(6)
    kinds = [(n, f"{i} {a} st") for n in ("red bolt", "red ring", "blue bolt", "tin") for i in (1, 4012) for a in ("small", "economy")] + [("red bolt", ""), (None, "1 small st"), ("red ring", None)]
    make = lambda n, c: [(f"{c}{i:03}", *rng.choice(kinds), rng.choice("XY")) for i in range(n)]
    q, p = make(90, "q"), [*make(300, "t"), ("t900", "red bolt", "1 small st", "X"), ("t900", "blue bolt", "", "X"), ("t901", "tin", "4012 economy st", "Y"), ("t901", "tin", "4012 economy st", "Y")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} string, name string, address string, country string")
    asked, pool = frame([*q, ("q900", "tin", "1 small st", "X"), ("q900", "tin", "4012 small st", "Y")], "qid"), frame(p, "tid")
    search, joined = blocking.search, []
    want = {n: sorted(map(tuple, search(blocking.keys(asked, "qid"), blocking.index(blocking.keys(pool, "tid")), n).collect())) for n in (1, 3, 40)}
    monkeypatch.setattr(blocking, "search", lambda a, b, top: joined.append((a.select("qid").distinct().count(), b.select("tid").distinct().count())) or search(a, b, top))
    for n, rows in want.items():
        assert sorted(map(tuple, blocking.structured(asked, pool, n).collect())) == rows
    assert all(a <= 2 * len(kinds) + 1 and b <= 2 * len(kinds) + 2 for a, b in joined)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_record_tables_are_not_broadcast(spark, sf):
    """Sides that grow with the records are shuffled, however small their files make them look."""
    recs = records.records(spark, sf)
    q, p = records.queries(recs), records.pool(recs)
    ranking = spark.createDataFrame([("Q1", "T1", 0.5, 1)], "qid string, tid string, rrf double, rrf_rank int")
    for made in (
        blocking.structured(q, p), fusion.expand_duplicates(ranking, blocking.duplicates(p)), fusion.cover(ranking, q), validate.outside(ranking, ranking),
        model.label(ranking, ranking), metrics.depth_frontier(q, ranking, ranking, (1, None)).limit(9),
    ):
        assert "Join" in planned(made) and "BroadcastHashJoin" not in planned(made)


def test_checks_read_what_was_written_once(spark):
    lists = spark.createDataFrame([("Q1", ["S2-1", "S2-2"]), ("Q2", ["S1-1"])], "qid string, ids array<string>").repartition(3, "qid").groupBy("qid").agg(F.first("ids").alias("ids")).cache()
    asked, known = frame(spark, [("Q1",), ("Q3",)], "qid string"), frame(spark, [("S2-1",), ("S1-1",)], "tid string")
    out = validate.check_outputs(lists, lists.where("qid = 'Q1'"), asked, known)
    got = {r["rule"]: (r["n"], r["examples"]) for r in out.collect() if r["n"]}
    assert got == {
        "not_a_candidate": (1, ["Q2|S1-1"]), "matches_missing_query": (1, ["Q3"]), "matches_extra_query": (1, ["Q2"]), "matches_self_match": (1, ["S1-1"]),
        "matches_unknown_id": (1, ["S2-2"]), "candidates_missing_query": (1, ["Q3"]), "candidates_unknown_id": (1, ["S2-2"]),
    }
    assert "InMemoryTableScan" not in planned(out) and "ExistingRDD" not in planned(out)


def test_dense_ties_and_passes(spark):
    rng = random.Random(4)
    v = lambda: [float(rng.choice([-1, 0, 1])) for _ in range(3)]
    q, p = {f"q{i}": v() for i in range(9)}, {f"t{i:04}": v() for i in range(3000)}
    frame = lambda d, key: spark.createDataFrame(list(d.items()), f"{key} string, v array<double>").repartition(3)
    got = sorted((r["qid"], r["tid"], r["rank"]) for r in products.dense(frame(q, "qid"), frame(p, "tid"), 5, query_block=4).collect())
    unit = lambda x: [a / (sum(b * b for b in x) ** 0.5 or 1) for a in x]
    want = []
    for i, a in q.items():
        best = sorted((-round(sum(x * y for x, y in zip(unit(a), unit(b), strict=True)), 6), j) for j, b in p.items())[:5]
        want += [(i, j, n) for n, (_, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_model_stops_early_and_comes_back(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("q"), F.col("id") % 60).alias("qid"), F.col("id").cast("string").alias("tid"), (F.col("id") % 3).alias("fold").cast("int"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("is_match", (F.col("a") > 0.5).cast("double"))
    settings_ = {"maxDepth": 2, "stepSize": 0.5}
    out, gains, trees = model.out_of_fold(rows, ["a", "b"], rounds=30, settings=settings_)
    assert out.count() == 600 == out.select("qid", "tid").distinct().count() and gains["a"] > gains["b"] and max(trees) < 30
    assert out.where((F.col("p") > 0.5) != (F.col("is_match") == 1)).count() < 15 and model.top_gains(gains, 1)[0][0] == "a"
    made = model.refit(rows, ["a", "b"], trees, settings=settings_)
    assert made.getNumTrees == round(sum(trees) / 3)
    model.save(made, ["a", "b"], str(tmp_path / "m"), trees=trees)
    again, names, notes = model.load(str(tmp_path / "m"), ["a", "b"])
    assert notes["trees"] == trees and model.predict(again, rows, names).select("p").collect() == model.predict(made, rows, names).select("p").collect()
    with pytest.raises(ValueError):
        model.load(str(tmp_path / "m"), ["b", "a"])
    with pytest.raises(ValueError):
        model.predict(made, rows, ["a"])


def test_weighted_rows_are_learned_as_repeated_ones(spark):
    """A row that stands for equal ones in each fold gives the trees, the least rows of a node and the predictions that those give."""
    rows = spark.range(90).select(F.col("id").cast("string").alias("tid"), (F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 4).alias("n"))
    rows = rows.withColumn("is_match", (F.col("a") + F.col("b") > 7).cast("double")).withColumn("weights", F.array(*[F.pmod(F.col("n") + k, F.lit(4)).cast("double") for k in range(3)])).drop("n")
    each = rows.select("*", F.posexplode("weights").alias("fold", "w")).select("tid", "a", "b", "is_match", "fold", F.explode(F.expr("array_repeat(0, cast(w as int))"))).drop("col")
    settings_ = {"maxDepth": 3, "stepSize": 0.5, "minInstancesPerNode": 9}
    got, want = (model.out_of_fold(x, ["a", "b"], rounds=3, settings=settings_)[0] for x in (rows, each))
    rounded = lambda x: {(r["tid"], r["fold"]): round(r["p"], 9) for r in x.collect()}
    assert rounded(got) == rounded(want) and got.agg(F.sum("weight")).head()[0] == each.count()


def test_settings_are_screened_with_all_their_rounds(spark, sf, monkeypatch):
    """A screen's models may have as many trees as any other model."""
    rows = spark.range(60).select(F.col("id").cast("string").alias("kind"), F.lit("t").alias("tid"), (F.col("id") % 2).cast("double").alias("is_match"), F.array(*[F.lit(1.0)] * 3).alias("weights"), *[F.col("id").cast("double").alias(f) for f in features.FEATURES])
    asked, real = [], model._classifier
    monkeypatch.setattr(catalog, "matcher_kinds", lambda d: (rows, None))
    monkeypatch.setattr(model, "_classifier", lambda rounds, *a: asked.append(rounds) or real(1, *a))
    assert {tuple(r)[1:] for r in catalog.QUERIES["model_screen"](spark, sf).collect()} == {(180, 180, 0)}
    assert asked == [40] * 12


def test_matcher_rows_of_a_kind_are_made_once(spark, sf, tmp_path, monkeypatch):
    """One row a kind of query and candidate, with the kind's queries by fold; all pairs come back with a prediction."""
    d = catalog.Data(spark, _copied(spark, sf, tmp_path, (0, 300, 600)))
    monkeypatch.setattr(catalog.Data, "candidates", lambda self: ((pairs := self.queries.select("qid", F.lit("S2-1").alias("tid"), F.lit(0.5).alias("rrf"))), pairs.select("qid", "tid", *[F.lit(0.5).alias(f"{c}_score") for c in fusion.CHANNEL_WEIGHTS])))
    rows, named = catalog.matcher_kinds(d)
    n = d.queries.withColumn("own", catalog.real_country(F.col("qid"))).select("name", "address", "country", "own").distinct().count()
    assert rows.count() == n < d.queries.count() == named.select("qid").distinct().count()
    assert rows.agg(F.sum(model.total_weight())).head()[0] == d.queries.count()


def test_backfill_with_its_own_ratio(spark):
    schema = "string, name string, address string, country string, text string"
    q = spark.createDataFrame([("Q1", "acme shop", "12 long road", "US", "acme shop 12 long road"), ("Q2", "zeta", "5 x", "US", "zeta 5 x")], f"qid {schema}")
    p = spark.createDataFrame([("T1", "akme shop", "9 short road", "US", "akme shop 9 short road"), ("T2", "other name", "3 x 12", "US", "acme shop 12 long roads"), ("T3", "acme shop", "12 long road", "France", "acme shop 12 long road"), ("T4", "zeta", "5 x", "US", "zeta 5 x")], f"tid {schema}")
    found = spark.createDataFrame([("Q2", "T4", 0.9, 1), ("Q1", "T4", 0.05, 1)], "qid string, tid string, score double, rank int")
    weak = lexical.weak(q, found, 2)
    assert [r["qid"] for r in weak.collect()] == ["Q1"]
    got = sorted((r["qid"], r["tid"], r["rank"]) for r in blocking.backfill(q, p, found, weak).collect())
    assert got == [("Q1", "T1", 2), ("Q1", "T2", 1), ("Q1", "T4", 3), ("Q2", "T4", 1)]  # another country, and a sure query, stay out


def test_candidates_are_blind_to_labels(spark, sf):
    """What is generated depends on texts alone, covers every query, and its digest does not move."""
    recs = records.records(spark, sf)
    asked, pool = records.queries(recs), records.pool(recs)
    make = lambda q, p: fusion.generate(q.select("qid"), p, fusion.retrieve(q, p), blocking.duplicates(p))
    found, channels = make(asked, pool)
    again, _ = make(asked.repartition(3), pool.repartition(5))
    digest = lambda x: sorted(map(tuple, fusion.set_hash(x.where("tid is not null")).collect()))
    assert digest(found) == digest(again) and found.select("qid").distinct().count() == asked.count()
    assert found.groupBy("qid").count().agg(F.max("count")).collect()[0][0] <= 100 and channels.columns[:4] == ["qid", "tid", "joint_score", "joint_rank"]
    siblings = blocking.duplicates(pool).select("tid", F.explode("siblings").alias("sibling"))
    stray = found.where("tid is not null").select("qid", "tid").join(channels, ["qid", "tid"], "left_anti")
    assert stray.join(siblings, "tid").count() >= stray.count()


def test_duplicates_are_counted_by_class(spark, monkeypatch):
    """The sizes are those of the unions, also where ids repeat or are in two classes; only what such ids touch is listed."""
    rng = random.Random(9)
    pool = [(f"T{i:02}", rng.choice("abc"), rng.choice("xy")) for i in range(40)] + [("T03", "a", "x"), ("T03", "b", "y"), ("T05", "c", "x"), ("T99", " ", "x")]
    make = lambda n: frame(spark, [(q, t) for q in ("Q1", "Q2", "Q3") for t in rng.sample([f"T{i:02}" for i in range(40)] + ["T99"], n)])
    channels = {"a": make(2), "b": make(5)}
    for rows in (pool, pool[:40], [("T99", " ", "x")]):
        siblings = blocking.duplicates(spark.createDataFrame(rows, "tid string, name string, address string"))
        want = fusion.cumulative_unions(channels, siblings).groupBy("step", "channel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("qid").alias("n_queries"))
        assert sorted(map(tuple, fusion.cumulative_sizes(channels, siblings).collect())) == sorted(map(tuple, want.collect()))
    none = {"a": channels["a"].limit(0)}
    assert fusion.cumulative_sizes(none, siblings).collect() == []


def test_ranks_of_duplicates_take_one_shuffle(spark):
    """What a list holds is found and ranked where its query was dealt to."""
    ranking = spark.createDataFrame([("Q1", "T1", 0.5, 1)], "qid string, tid string, rrf double, rrf_rank int")
    siblings = spark.createDataFrame([("T1", ["T2"])], "tid string, siblings array<string>")
    plan = planned(fusion.expand_duplicates(ranking, siblings))
    assert "LeftAnti" not in plan and plan.partition("Union")[0].count("Exchange hashpartitioning(qid") == 1


def test_written_tables_free_their_shuffles(spark):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before = files()
    rows = session.written(spark.range(100).withColumn("g", F.col("id") % 3).groupBy("g").count())
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and rows.count() == 3


def test_depth_frontier_deals_pairs_once(spark):
    """Links and ranked pairs are shuffled by query and not again; pairs that repeat, pairs without an id and queries without any count as before."""
    ranking = frame(spark, [("Q1", "T1", 1), ("Q1", "T2", 2), ("Q1", "T2", 3), ("Q1", None, 4), ("Q2", "T1", 1), ("Q9", "T1", 1)], "qid string, tid string, rrf_rank int")
    truth = frame(spark, [("Q1", "T2"), ("Q1", "T2"), ("Q1", "T7"), ("Q3", "T1"), ("Q9", "T1")])
    required = frame(spark, [("Q1",), ("Q2",), ("Q3",), ("Q4",)], "qid string")
    out = metrics.depth_frontier(required, truth, ranking, (2, None))
    plan = planned(out)
    assert "hashpartitioning(tid" not in plan and "hashpartitioning(qid" in plan and not re.search(r"hashpartitioning\(qid#\d+, tid", plan)
    counts = [("Q1", 2, 2, 1, None, 4, 2), ("Q2", 0, 1, 0, None, 1, 0), ("Q3", 1, 0, 0, None, 0, 0), ("Q4", 0, 0, 0, None, 0, 0)]
    rows = [(q, n, k, a, b) for q, n, p2, t2, _, p, t in counts for k, a, b in ((2, p2, t2), (None, p, t))]
    want = metrics.candidate_report(frame(spark, rows, "qid string, n_true long, k int, n_pred long, n_tp long"), ["k"])
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_written_tables_start_no_process_for_a_folder(spark, tmp_path):
    """Folders have this process's mask and not the one that Hadoop sets by a process of its own; there is no mark of success."""
    mask = os.umask(0o027)
    try:
        session.write(spark.range(5), f"file://{tmp_path}/a/t")
        rows = session.written(spark.range(3))
    finally:
        os.umask(mask)
    assert (tmp_path / "a/t").stat().st_mode & 0o777 == 0o750 and {x.name[:5] for x in (tmp_path / "a/t").iterdir() if x.suffix != ".crc"} == {"part-"}
    folder = Path(rows.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert folder.stat().st_mode & 0o777 == 0o750 and not (folder / "_SUCCESS").exists()
    assert rows.count() == 3 and spark.read.parquet(f"{tmp_path}/a/t").count() == 5
    with pytest.raises(FileExistsError):
        session.write(spark.range(5), f"{tmp_path}/a/t")


def test_channels_are_written_one_by_one(spark, monkeypatch):
    """No plan holds the searches of two channels, and what is written is what one plan of all gives."""
    made, real = [], session.written
    monkeypatch.setattr(session, "written", lambda df: made.append(planned(df)) or real(df))
    channels = {c: hits(spark).where(F.col("channel") == c).drop("channel").withColumn("score", F.max("score").over(W.partitionBy("qid", "tid"))) for c in ("joint", "name_only")}
    pool = frame(spark, [("T1", "a", "x"), ("T9", "a", "x"), ("T2", "b", "y")], "tid string, name string, address string")
    found, looked = fusion.generate(frame(spark, [("Q1",), ("Q3",)], "qid string"), pool, channels, blocking.duplicates(pool))
    assert sum("Window" in x and "Scan ExistingRDD" in x for x in made) == 2 and not any(x.count("Scan ExistingRDD") > 1 for x in made)
    want = fusion.lookups(fusion.stack(channels), channels)
    assert sorted(map(str, looked.collect())) == sorted(map(str, want.collect()))
    assert [(r["qid"], r["tid"]) for r in found.orderBy("qid", "rrf_rank").collect()] == [("Q1", "T2"), ("Q1", "T1"), ("Q1", "T9"), ("Q1", "T4"), ("Q3", None)]


def _copied(spark, sf, tmp_path, shifts=(0, 300, 601)):
    """A folder with copies of the parts under shifted keys."""
    part = spark.read.parquet(f"{sf}/part.parquet").limit(60)
    for i in shifts:
        part.withColumn("p_partkey", F.col("p_partkey") + i).write.mode("append").parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_candidates_are_sought_once_a_kind(spark, sf, tmp_path, monkeypatch):
    """Queries that are written alike are searched once; each gets what it would get by itself."""
    d = catalog.Data(spark, _copied(spark, sf, tmp_path))
    want = [x.collect() for x in fusion.generate(d.required(), d.pool, fusion.retrieve(d.queries, d.pool), blocking.duplicates(d.pool))]
    asked, real = [], fusion.retrieve
    monkeypatch.setattr(fusion, "retrieve", lambda q, p, *a: asked.append(q.count()) or real(q, p, *a))
    got = [x.select(*want[i][0].__fields__).collect() for i, x in enumerate(d.candidates())]
    assert [sorted(map(str, x)) for x in got] == [sorted(map(str, x)) for x in want] and len(got[0]) > 100
    assert asked == [d.queries.select("name", "address", "country").distinct().count()] and asked[0] < d.queries.count()


def test_pair_features_read_written_hits_and_views(spark, sf):
    d = catalog.Data(spark, sf)
    d.hits = lambda made=d.hits(): made
    assert "Window" not in planned(d.hits()) and "Join" not in planned(d.hits())
    assert "regexp_replace" not in planned(catalog._pair_features(d))


def test_settings_are_screened_one_plan_each(spark, sf):
    """What comes back reads the counts of each setting, and holds no model."""
    out = catalog.QUERIES["model_screen"](spark, sf)
    plan = planned(out)
    assert plan.count("FileScan") == 4 and "UDF" not in plan and "Exchange" not in plan
    rows = out.collect()
    assert [r["arm"] for r in sorted(rows)] == [f"depth-{k}" for k in (1, 2, 3, 4)] and len({(r["n"], r["n_pairs"], r["n_bad"]) for r in rows}) == 1


def test_matcher_rows_read_written_views(spark, sf):
    """Records are normalised in plans of their own, candidates are settled before the features."""
    d = catalog.Data(spark, sf)
    pair = d.queries.limit(1).crossJoin(d.pool.select("tid").limit(1)).select("qid", "tid")
    found = pair.select("qid", "tid", F.lit(0.5).alias("rrf"), F.lit(1).alias("rrf_rank"))
    channels = pair.select("qid", "tid", *[F.lit(0.25).alias(f"{c}_score") for c in fusion.CHANNEL_WEIGHTS])
    d.candidates = lambda: (found, channels)
    rows = catalog.matcher_rows(d)
    assert "regexp_replace" not in planned(rows) and "CartesianProduct" not in planned(rows)
    got = rows.collect()
    assert [(r["n_channels"], r["tfidf_max"], r["rrf_best"]) for r in got] == [(4.0, 0.25, 0.5)]


def test_written_outputs(spark, tmp_path):
    scored = spark.createDataFrame([("b", "y", 0.5), ("a", "x", 0.25)], "qid string, tid string, p double")
    sinks.write_predictions(scored, str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == [("a", "x", 0.25), ("b", "y", 0.5)]
    with pytest.raises(ValueError):
        sinks.write_scores(scored.unionByName(scored), str(tmp_path / "s"))
    assert "The first 1 rows." in sinks.report("t", scored, 1) and "first" not in sinks.report("t", scored, 2)
    assert sinks.report_json("t", scored, 1)["complete"] is False
    here = tables.revision(str(Path(__file__).resolve().parents[1]))
    assert len(here["commit"]) == 40 and here["changed"] in (True, False)


@pytest.mark.parametrize(("word", "want"), [("Tymczak", "T520"), ("Pfister", "P123"), ("12ab", "A100"), ("", "")])
def test_soundex(spark, word, want):
    assert one(spark, text.soundex(F.col("s")), s=word) == want


def brute_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 2 * table[-1][-1] / (len(a) + len(b)) if a or b else 1.0


def brute_partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 1.0
    return max(brute_ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


@given(st.text("abcx ", max_size=9), st.text("abcy ", max_size=14))
def test_partial_ratio(a, b):
    assert fuzzy.partial_ratio(a, b) == pytest.approx(brute_partial(a, b))


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratios(a, b):
    assert fuzzy.ratio(a, b) == pytest.approx(brute_ratio(a, b))
    assert fuzzy.weighted_ratio(a, b) == pytest.approx(fuzzy.weighted_ratio(b, a))
    for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.weighted_ratio):
        assert 0 <= f(a, b) <= 1 + 1e-12
    assert fuzzy.token_set_ratio("new york mets", "mets york new") == 1.0 and fuzzy.partial_ratio("york", "new york mets") == 1.0


def test_features(spark):
    side = lambda c: text.normalized(F.col(f"{c}n"), F.col(f"{c}a"), F.lit("US"))
    base = spark.createDataFrame([("S1-1", "S2-1", "Acme Inc", "1 Main St", "Acme LLC", "1 Main St", 0.5, 2, 0.03)], "qid string, tid string, qn string, qa string, tn string, ta string, score double, channels int, rrf double")
    row = features.pair_features(base.withColumn("q", side("q")).withColumn("t", side("t"))).collect()[0].asDict()
    assert list(row)[2:] == list(features.FEATURES) and len(features.FEATURES) == 23
    assert row["name_core_jac"] == 1.0 and row["house_equal"] == 1.0 and row["source_is_s2"] == 1.0 and row["pin_equal"] == 0.0
    with pytest.raises(ValueError):
        model.assert_schema(features.FEATURES, features.DENSE_FEATURES)
    assert one(spark, F.size(features.char_grams(F.col("s"))), s="ab") == 0


def test_dense(spark):
    p = spark.createDataFrame([("P1", [1.0, 0.0]), ("P2", [0.0, 1.0]), ("P3", [0.7071, 0.7071])], "tid string, v array<double>")
    q = spark.createDataFrame([("Q1", [1.0, 0.0]), ("Q2", [0.0, 1.0])], "qid string, v array<double>")
    got = dense.search(q, p, 2).where("rank = 1").orderBy("qid").collect()
    assert [r["tid"] for r in got] == ["P1", "P2"]
    assert dense.search(q.limit(0), p, 2).collect() == []
    vectors = dense.encode(spark.createDataFrame([("a", "xx"), ("b", None)], "id string, text string"), "id", lambda texts: [[len(t), 0.0] for t in texts])
    assert {r["id"]: r["v"] for r in vectors.collect()} == {"a": [1.0, 0.0], "b": [0.0, 0.0]}
    t = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "t array<array<double>>, m array<int>")
    a, b = (r["v"] for r in t.select(dense.mean_pool(F.col("t"), F.col("m")).alias("v")).collect())
    assert a == pytest.approx([0.5**0.5] * 2) and b == [0.0, 0.0]


def test_grams(spark):
    row = spark.createDataFrame([("ab  abcd",)], "s string").select(lexical.grams(F.col("s")).alias("g")).collect()[0]["g"]
    assert row == [" ab", "ab ", " ab ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd "]


def test_splits(spark):
    ids = spark.createDataFrame([(f"S1-{i}", "US" if i % 2 else "FR") for i in range(400)], "qid string, country string")
    made = splits.roles(ids, "qid", {"a": 30, "b": 40}, "country")
    assert made.count() == 140 and splits.overlaps(made, "qid").count() == 0 and splits.uncovered(ids, made, "qid").count() == 260
    assert {r["split"] for r in splits.build_splits(ids, "qid").select("split").distinct().collect()} == {"train", "dev", "holdout", "dev-exposed"}


def test_blocking_caps_and_ties(spark):
    pool = spark.createDataFrame([(f"S2-{i:03}", "same name", "1 long street", "US") for i in range(200)], "tid string, name string, address string, country string")
    kinds = {r["key_type"] for r in blocking.index(blocking.keys(pool, "tid")).select("key_type").distinct().collect()}
    assert kinds == {"exact", "house", "prefix"}  # tokens and places have 200 postings, over their caps
    over = {r["key_type"]: r["n_over"] for r in blocking.overflow(blocking.keys(pool, "tid")).collect()}
    assert over["token"] == 2 and over["exact"] == 0
    got = blocking.structured(pool.limit(1).withColumnRenamed("tid", "qid"), pool, 3).orderBy("rank").collect()
    assert [r["tid"] for r in got] == ["S2-000", "S2-001", "S2-002"]


def test_validator(spark):
    header = "source1_entity_id\tmatched_entity_ids"
    required = frame(spark, [("S1-1",), ("S1-2",), ("S1-3",)], "qid string")
    known = frame(spark, [("S2-1",), ("S3-1",)], "tid string")
    lines = lambda body, head=header: spark.createDataFrame(list(enumerate([head, *body])), "line_no int, value string")
    found = lambda x: {r["rule"] for r in validate.check_lists(x, header, required, known).collect() if r["n"]}
    good = ["S1-1\tS2-1,S3-1", "S1-2\t", "S1-3\tS2-1"]
    assert found(lines(good)) == set()
    assert found(lines(good, "a,b")) == {"header"}
    assert found(lines([*good, "S1-3\t"])) == {"duplicate_query"}
    assert found(lines(["S1-1\tS2-1,S2-1", *good[1:]])) == {"duplicate_id"}
    assert found(lines(["S1-1\tS1-2", *good[1:]])) == {"self_match", "unknown_id"}
    assert found(lines(["S1-1\tX-2", *good[1:]])) == {"bad_prefix", "unknown_id"}
    assert found(lines(good[1:])) == {"missing_query"}
    assert found(lines([*good, "S1-9\t"])) == {"extra_query"}
    assert found(lines([*good, "no tab"])) == {"malformed"}
    chunks = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2)], "qid string, chunk int")
    assert {r["rule"]: r["n"] for r in validate.check_chunks(chunks, frame(spark, [("a",), ("d",)], "qid string")).collect()} == {"in_two_chunks": 1, "missing": 1, "extra": 2}


def test_files(spark, tmp_path):
    pairs = frame(spark, [("S1-2", "S3-1"), ("S1-2", "S2-9"), ("S1-2", "S2-9")])
    lists = sinks.id_lists(frame(spark, [("S1-1",), ("S1-2",)], "qid string"), pairs)
    sinks.write_lists(lists, str(tmp_path / "out"), "matched_entity_ids", 1)
    body = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert body == "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-9,S3-1\n"
    back = {r["qid"]: r["ids"] for r in tables.truth(spark, str(tmp_path / "out")).collect()}
    assert back == {"S1-1": [], "S1-2": ["S2-9", "S3-1"]}
    assert tables.held_truth(spark, str(tmp_path / "out")).count() <= 2
    with pytest.raises(ValueError):
        tables.id_lists(spark, str(tmp_path / "out"), "candidate_entity_ids").collect()
    sinks.write_json(str(tmp_path / "m.json"), {"query_ids": ["S1-1", "S1-2"], "seed": "x"})
    assert json.loads((tmp_path / "m.json").read_text())["seed"] == "x" and tables.manifest(spark, str(tmp_path / "m.json")).count() == 2
    sinks.write_chunks(lists.withColumn("country", F.lit("US")).withColumn("chunk", F.length("ids")), str(tmp_path / "chunks"))
    assert sinks.merge_chunks(spark, str(tmp_path / "chunks"), lists).count() == 2
    with pytest.raises(ValueError):
        sinks.merge_chunks(spark, str(tmp_path / "chunks"), frame(spark, [("S1-1",), ("S1-3",)], "qid string"))
    pairs.write.parquet(str(tmp_path / "bundle.parquet"))
    assert tables.bundle(spark, str(tmp_path)).count() == 3 and tables.complete(spark, str(tmp_path), ("bundle.parquet", "x")) == ["x"]
    assert tables.file_hashes(spark, str(tmp_path / "m.json")).collect()[0]["bytes"] > 0
    assert "| qid | tid |" in sinks.report("pairs", pairs)


def test_stream(spark, sf, tmp_path):
    recs = records.records(spark, sf)
    asked, pool = records.queries(recs), records.pool(recs)
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    microbatch.link(stream, pool, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = blocking.structured(asked, pool, 20)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_bootstrap(spark):
    a = spark.createDataFrame([(str(i), "US" if i % 2 else "FR", 0.5) for i in range(60)], "qid string, country string, f05 double")
    got = metrics.paired_bootstrap(a, a.withColumn("f05", F.lit(0.75)), 200, 1, "country")
    assert got["delta"] == pytest.approx(0.25) and got["low"] == pytest.approx(0.25) and got["high"] == pytest.approx(0.25)
