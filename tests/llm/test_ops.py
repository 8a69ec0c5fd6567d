"""The corpus operators against brute force, round trips and held-out labels."""

import hashlib
import importlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat, common, decontam, exact, html, langid, mixing, queries, segments, simhash, substring, suffix, toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def table(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    assert plain(df.select(*order)) == sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=repr)


# --- edge cases of every operator --------------------------------------------------------------

ODD = [(1, "same words here"), (1, "same words here"), (2, None), (None, ""), (3, "samewords  here"), (None, None), (4, "word " * 3000), (5, " \t\n"), (6, "Ünï çødé ß 漢字 \U0001f600"), (7, "x")]


@pytest.mark.parametrize(
    ("run", "per_row"),
    [
        (lambda s, d: langid.identify(d, langid.learn(d.withColumn("lang", F.lit("aa")))), True),
        (lambda s, d: mixing.mix(d), True),
        (lambda s, d: exact.groups(d), True),
        (lambda s, d: exact.deduplicate(d), False),
        (lambda s, d: substring.remove(d), True),
        (lambda s, d: simhash.classes(d, words=3, exact=True), True),
        (lambda s, d: simhash.deduplicate(d), False),
        (lambda s, d: suffix.remove(d), True),
        (lambda s, d: toxicity.score(d, toxicity.learn(d, s.createDataFrame([(1, 1), (3, None), (None, 0), (7, 0), (7, 1)], "doc_id long, toxic int"))), True),
        (lambda s, d: decontam.leaks(d, s.createDataFrame([(1, "samewords here"), (2, None), (None, "")], "item_id long, text string")), None),
        (lambda s, d: decontam.clean(d, s.createDataFrame([], "item_id long, text string")), True),
    ],
)
def test_odd_rows(spark, docs, run, per_row):
    frame = docs(ODD).withColumn("key", F.lit("k")).withColumn("fp", F.lit(1)).withColumn("_row", F.lit(None).cast("string")).withColumn("text_hash", F.lit("h"))
    out = run(spark, frame)
    n = out.count()
    assert per_row is None or (n == len(ODD) if per_row else 0 < n < len(ODD))
    assert run(spark, frame.limit(0)).count() == 0


@pytest.mark.parametrize("run", [exact.deduplicate, simhash.deduplicate, lambda d: toxicity.reject(d, toxicity.learn(d, d.select("doc_id", F.lit(0).alias("toxic")).limit(0))), lambda d: decontam.clean(d, d.select(F.lit(1).alias("item_id"), F.lit("nothing of this is there").alias("text")))])
def test_clashing_column_names(spark, docs, run):
    """Every column comes through with its value, whatever its name."""
    names = ["crawl-date", "a.b", "_null", "_stay_id", "_bad_id", "bad_id", "stay_id", "BAD_HASH", "stay_hash", "was_null", "c0", "key", "n", "bucket", "row", "id", "_row", "_text", "_score", "fp", "v", "text_hash", "two words", "q`t"]
    frame = docs([(1, "one text of a few words"), (2, None), (3, "another, quite different, text of more words")])
    for i, name in enumerate(names):
        frame = frame.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    out = run(frame)
    assert out.columns == frame.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[2]["text"] is None and all(got[d][5 + i] == f"{i}-{d}" for d in got for i in range(len(names)))


def test_odd_pages_and_chats(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/x", ""), (2, "http://a/x", "<p>a"), (None, "x", "no tags &amp; <b>bold")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html.extract_pages(pages).collect()) == ["", "", "a", "no tags & bold"]
    assert html.extract_pages(pages.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "a\\b</s>\\"), (1, 1, "user", "<|end|>[INST]\\"), (1, 2, "assistant", None), (1, 3, "assistant", "x<\\/s>"), (None, 0, None, "q"), (2, None, "assistant", "<"), (2, None, "assistant", "<")], "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(rows)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "a\\b</s>\\"), ("user", "<|end|>[INST]\\"), ("assistant", ""), ("assistant", "x<\\/s>")]
    assert back[1]["loss_text"] == "x<\\/s>" and back[2]["loss_text"] == "<<" and [t["text"] for t in back[None]["turns"]] == ["q"]
    inner = back[1]["formatted"][3:-4]
    assert "</s>" not in inner and "[INST]" not in inner and inner.count("<|start|>") == 2
    assert chat.format_chat(rows.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('é <s> ', id) as text")
    begin = time.time()
    back = chat.read_back(chat.format_chat(rows)).select(F.size("turns").alias("n"), F.md5("loss_text").alias("loss")).collect()[0]
    assert back["n"] == n and back["loss"] == hashlib.md5("".join(f"é <s> {i}" for i in range(1, n, 2)).encode()).hexdigest()
    assert time.time() - begin < 40


def test_any_mask_reads_back(spark):
    rows = spark.createDataFrame([(1, i, r, f"t{i}<s>") for i, r in enumerate(["user", "assistant", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    made = chat.format_chat(rows)
    whole = made.withColumn("loss_spans", F.expr("array(named_struct('start', 3, 'length', 9), named_struct('start', 16, 'length', 2))"))
    got = chat.read_back(whole).collect()[0]
    assert got["loss_text"] == chat_text(got["formatted"][3:12]) + chat_text(got["formatted"][16:18])
    assert chat.read_back(made.withColumn("loss_spans", F.slice("loss_spans", 2, 1))).collect()[0]["loss_text"] == "t2<s>"


def chat_text(x):
    return re.sub(r"(?s)\\(.)", r"\1", x)


LONG = " ".join(f"word{i % 5000}" for i in range(150_000))  # about 1.3 MB
CASES = [(1, "the cat and the dog are here"), (1, "the cat and the dog are here"), (2, None), (3, ""), (4, " \t\n"), (5, "12 34 !?"), (6, LONG), (None, "the dog"), (7, "Ünï çødé ß 漢字 \U0001f600")]


def clashing(frame):
    """With columns named like those that the operators make."""
    for name in ("key", "fp", "_row", "text_hash", "size", "score", "held_out", "skey", "order", "shard", "_id", "toxic", "numbers", "bucket"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def test_language_of_odd_rows(spark, docs):
    train = docs([(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("no language", None), (None, "en")] * 3)])
    model = langid.learn(train)
    got = {(r["doc_id"], (r["lang_pred"], r["score"])) for r in langid.identify(clashing(docs(CASES)), model).collect()}
    assert {d: x for d, x in got if d in (2, 3, 4, 5)} == {d: ("und", 0.0) for d in (2, 3, 4, 5)} and len([1 for d, _ in got if d == 1]) == 1
    assert dict(got)[1][0] == "en" and dict(got)[None][0] == "en" and dict(got)[6][0] in ("en", "de") and all(0 <= s <= 1 for _, (_, s) in got)
    assert {r["lang_pred"] for r in langid.identify(docs(CASES), ([], model[1])).collect()} == {"und"}
    tie = langid.learn(docs([(0, "aaa bbb", "y"), (1, "aaa bbb", "x")]))
    assert langid.identify(docs([(9, "aaa bbb")]), tie).collect()[0]["lang_pred"] == "x"  # equal proportions: code-point order


def test_mix_of_odd_rows(spark, docs):
    rows = [(d, t, None, s) for (d, t), s in zip(CASES, ["a", "a", "a", None, "b", "b", "é", "é", None], strict=True)]
    out = mixing.mix(clashing(docs(rows)).drop("size", "order", "skey", "shard")).collect()
    sizes = sorted((repr(r["doc_id"]), r["size"]) for r in out)
    assert sizes == sorted((repr(d), len(SPACE.sub(" ", t or "").split())) for d, t in CASES)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out) and mixing.mix(docs(rows).limit(0)).count() == 0
    total = sum(n for _, n in sizes)
    by = defaultdict(int)
    for r in out:
        by[r["source"]] += r["taken"]
    assert sum(by.values()) == pytest.approx(1.5 * total, rel=0.02)
    again = mixing.mix(docs(rows).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, map(tuple, out)))


def test_toxicity_of_odd_rows(spark, docs):
    train = [(100 + i, f"you are a stupid zorgon number {i}" if i % 4 == 0 else f"a kind word about the weather {i}") for i in range(240)]
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(240)] + [(100, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs(train + train[:1] * 50), labels)
    got = {r["doc_id"]: r for r in toxicity.score(clashing(docs(CASES + [(8, "such a stupid zorgon"), (9, LONG + " stupid zorgon")])), model).collect()}
    assert got[8]["predicted"] == 1 and all(got[d]["predicted"] == 0 for d in (1, 2, 3, 4, 5, 6, 7, None))
    assert got[2]["score"] == got[3]["score"] == got[4]["score"] and 0 <= got[2]["score"] < 0.3
    assert toxicity.reject(clashing(docs(CASES)), model).count() == len(CASES)


def test_leaks_of_odd_rows(spark, docs):
    bench = spark.createDataFrame([(1, "word7 word8 word9 word10 word11 word12"), (1, "word7 word8 word9 word10 word11 word12"), (2, None), (3, ""), (4, "?!"), (None, "the cat and the dog are here")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.leaks(clashing(docs(CASES)), bench).collect()]
    assert sorted(got, key=repr) == sorted([(1, None), (1, None), (6, 1)], key=repr)  # repeated documents have their own rows
    left = decontam.clean(clashing(docs(CASES)), bench)
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([2, 3, 4, 5, None, 7], key=repr)
    assert decontam.leaks(docs(CASES).limit(0), bench).count() == decontam.leaks(docs(CASES), bench.limit(0)).count() == 0


def test_pages_of_odd_rows(spark):
    story = " ".join(f"word{i}" for i in range(40_000))
    pages = [(1, "http://a/1", f"<article><p>{story}</p></article>"), (2, None, "<p>a&amp;b"), (2, None, "<p>a&amp;b"), (None, "", None), (3, "http://a/2", "<article>same</article><article>same</article>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("paths", F.lit("y")).withColumn("text", F.lit("z"))
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html.extract_pages(frame).collect()), key=repr)
    assert got == sorted([(1, "http://a/1", story), (2, None, "a&b"), (2, None, "a&b"), (None, "", ""), (3, "http://a/2", "same\nsame")], key=repr)


def test_near_copies_of_odd_rows(spark, docs):
    kept = simhash.deduplicate(clashing(docs(CASES + [(8, LONG + " end"), (0, "THE cat and the dog are here")]))).collect()
    # empty and wordless texts are one group, texts without a twin stay
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted([0, 2, 5, 6, None, 7], key=repr)


# --- single operators ---------------------------------------------------------------------------


def test_language(spark, sf):
    got = langid.query(spark, sf).join(table(spark, sf).select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in held["doc_id"]]).all()
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.97 and got["score"].between(0, 1).all()
    model = langid.learn(table(spark, sf))
    texts = {r["lang"]: r["text"] for r in table(spark, sf).where("n_chars > 1500").collect()}
    mix = langid.proportions(langid.trigrams(texts["en"][:1400] + " " + texts["de"][:700]), model[1])
    assert [model[0][i] for i, _ in mix[:2]] == ["en", "de"] and mix[0][1] == pytest.approx(2 / 3, abs=0.15)


def brute_targets(size, weights=(5, 2, 1)):
    keys = sorted((k for k in size if k is not None)) + ([None] if None in size else [])
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    total, target, full = 1.5 * sum(size.values()), {}, set()
    while True:
        left = total - sum(2 * size[k] for k in full)
        target = {k: 2.0 * size[k] if k in full else left * w[k] / sum(w[x] for x in keys if x not in full) for k in keys}
        over = {k for k in keys if k not in full and target[k] > 2 * size[k]}
        if not over:
            return target
        full |= over


def test_mixing(spark, docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), None, rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    out = mixing.mix(docs(rows)).toPandas()
    assert plain(mixing.mix(docs(rows).repartition(7))) == sorted(map(tuple, out.astype(object).where(out.notna(), None).to_numpy().tolist()), key=repr)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(t.split())
    want = brute_targets(size)
    assert ((out["taken"] >= 0) & (out["taken"] <= 2 * out["size"])).all()
    for s in size:
        own = out[out["source"].isna()] if s is None else out[out["source"] == s]
        assert own["target"].iloc[0] == pytest.approx(want[s]) and own["source_size"].iloc[0] == size[s]
        assert own["taken"].sum() == pytest.approx(want[s], rel=0.02, abs=4)


def test_sainte_lague(spark):
    rows = [("g", str(i), v) for i, v in enumerate([340, 280, 160, 60, 15, 0])] + [("h", str(i), 10) for i in range(7)]
    seats = {"g": 15, "h": 3}
    frame = spark.createDataFrame([(g, k, v, seats[g]) for g, k, v in rows], "g string, _key string, v long, n long")
    got = {(r["g"], r["_key"]): r["s"] for r in mixing._apportion(frame, ["g"], "v", "n", "s").collect()}
    for g, n in seats.items():
        have = {k: 0 for a, k, _ in rows if a == g}
        for _ in range(n):
            best = min(have, key=lambda k: (-dict((b, v) for a, b, v in rows if a == g)[k] / (2 * have[k] + 1), k))
            have[best] += 1
        assert {k: got[g, k] for k in have} == have


def test_directory_splits():
    deep, buckets = exact.directory({0: 100, 1: 100, 40000: 50}, 120)
    assert deep == exact.PREFIX_BITS and sum(2 ** (exact.PREFIX_BITS - d) for _, d in buckets) == 2**exact.PREFIX_BITS
    assert exact.directory({}, 1) == (0, [(0, 0)])
    deep, buckets = exact.directory({7: 1000}, 120)
    assert deep == exact.PREFIX_BITS + 4 and sum(2 ** (64 - d) for _, d in buckets) == 2**64


def test_one_of_many_equal_rows_stays(spark, docs):
    got = [tuple(r)[:4] for r in exact.groups(docs([(1, "x y")] * 50 + [(1, "xy"), (0, "x y"), (None, "x  y")])).collect()]
    assert {g[1:3] for g in got} == {(None, 53)} and [g[0] for g in got if g[3]] == [None]
    got = [tuple(r)[:4] for r in exact.groups(docs([(1, "x y")] * 50 + [(None, "x y")])).collect()]
    assert sum(g[3] for g in got) == 1 and [g[0] for g in got if g[3]] == [1]


def test_small_tables_are_written_by_few_tasks(spark, docs, monkeypatch):
    """However finely the shuffles are dealt; a hot text and single ones come out as before, from as few tasks."""
    made, real = {}, common.Scratch.put
    monkeypatch.setattr(common.Scratch, "put", lambda self, df, name: made.setdefault(name, real(self, df, name)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("31", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        out = exact.groups(docs([(i, f"text {i}" if i % 2 else " hot") for i in range(300)]).repartition(29))
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()}
        most = max(spark.sparkContext.defaultParallelism, 1)
        files = {name: sum(x.startswith("part-") for x in os.listdir(os.path.dirname(df.inputFiles()[0].removeprefix("file:")))) for name, df in made.items()}
        assert set(files) == {"index", "digests", "known"} and max(files.values()) <= most and out.rdd.getNumPartitions() <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: (i, 1, True) if i % 2 else (0, 150, i == 0) for i in range(300)}


def test_chains_compare_bytes(spark, docs, monkeypatch):
    """With one key for all, only the bytes tell the texts apart."""
    monkeypatch.setattr(exact, "_key", lambda data: 7)
    out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.groups(docs([(1, "a"), (2, "b"), (3, " a"), (4, "c")])).collect()}
    assert out == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def brute_words(rows, length=13):
    lists = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in lists:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, math.inf), math.inf if d is None else d)
    out = []
    for d, w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (math.inf if d is None else d):
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, length=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), len(segments.runs_of(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "shard"), [(segments.HOT_SEGMENTS, suffix.SHARD_BYTES), (0, suffix.SHARD_BYTES), (segments.HOT_SEGMENTS, 3000)])
def test_substrings(spark, sf, docs, monkeypatch, hot, shard):
    monkeypatch.setattr(segments, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(substring, "SHARD_BYTES", shard)
    rng = random.Random(2)
    passage = " ".join(str(rng.random()) for _ in range(60))
    extra = [(None, "a " * 300), (7, "a " * 40), (900, "é" * 900), (901, passage), (902, f"begin {passage} end"), (903, passage[:500]), (904, f"x{passage}"), (903, "other"), (None, passage)]
    frame = table(spark, sf).select("doc_id", "text").where("n_chars < 4000")
    frame = frame.unionByName(frame.orderBy("doc_id").limit(20)).unionByName(docs(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in frame.collect()]
    assert plain(substring.remove(frame).drop("kept")) == brute_words(rows)
    assert plain(suffix.remove(frame).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256")) == brute_bytes(rows)


@pytest.mark.parametrize("chunk", [700, 5000])
def test_substrings_of_long_texts(spark, sf, docs, monkeypatch, chunk):
    """Texts longer than a piece, and repeated rows of them."""
    monkeypatch.setattr(segments, "CHUNK", chunk)
    frame = table(spark, sf).select("doc_id", "text").where("n_chars < 12000 and n_chars > 900").limit(40)
    extra = [(1000, " \n".join(f"w{i % 900}" for i in range(4000))), (1001, "\t " + "é b " * 3000), (1002, "x" * 9000), (1003, " "), (None, "one " * 2000)]
    frame = frame.unionByName(docs(extra + extra[:1], "doc_id long, text string"))
    rows = [tuple(r) for r in frame.collect()]
    assert plain(substring.remove(frame).drop("kept")) == brute_words(rows)
    assert plain(suffix.remove(frame).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256")) == brute_bytes(rows)


def test_very_many_equal_rows(spark):
    """Time is linear in the rows that are equal in id and text."""
    frame = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "repeat('some words that are here again and again ', 40) as text")
    begin = time.time()
    got = suffix.remove(frame).groupBy("n_bytes", "n_removed", F.size("spans").alias("s")).count().collect()
    assert [tuple(r) for r in got] == [(1640, 1640, 1, 20_000)]
    assert [tuple(r) for r in substring.remove(frame).groupBy("n_removed").count().collect()] == [(0, 20_000)]
    assert time.time() - begin < 90


@pytest.mark.parametrize(("n", "letters"), [(0, 2), (1, 2), (60, 2), (2500, 2), (3000, 4), (400, 1)])
def test_suffix_array(n, letters):
    data = np.random.default_rng(n).integers(97, 97 + letters, n).astype(np.uint8)
    b = data.tobytes()
    order = suffix.suffix_array(data)
    assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
    shared = suffix.common_prefixes(data, order)
    for k in range(1, n):
        x, y = b[order[k - 1] :][:200], b[order[k] :][:200]
        assert shared[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def brute_print(text, k=3):
    w = text.encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "A b C d É e", "x " * 30000, " q\x0bw\x0ce\nr  t ", "one two three four two three four"])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text), "big") == brute_print(text)


def groups_of(labels):
    found = defaultdict(list)
    for i, x in enumerate(labels):
        found[x].append(i)
    return sorted(map(tuple, found.values()))


@pytest.mark.parametrize("fan", [2, 8])
def test_gray_index(monkeypatch, fan):
    monkeypatch.setattr(simhash, "FAN", fan)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ flip() ^ flip() for _ in range(12)]))
    key = rng.integers(0, 3, len(fp)).astype(np.int64)
    near = (np.bitwise_count(fp[:, None] ^ fp) <= 3) & (key[:, None] == key)
    label = np.arange(len(fp))
    while (label != (new := np.array([label[row].min() for row in near]))).any():
        label = new
    assert groups_of(simhash.GrayIndex(key, fp[:, None]).forest()) == groups_of(label)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 50 + i) for i in range(20)] + [(200, 201), (201, 200), (300, 300)]
    scratch = common.Scratch(spark, "test")
    got = {r["v"]: r["label"] for r in simhash.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert len({got[i] for i in range(1, 31)}) == 1 and len({got[50 + i] for i in range(20)} | {got[100]}) == 1 and got[200] == got[201]
    assert simhash.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "none")).count() == 0


@pytest.mark.parametrize("most", [simhash.GROUP_ROWS, 3])
def test_simhash_classes(spark, sf, monkeypatch, most):
    monkeypatch.setattr(simhash, "GROUP_ROWS", most)
    got = simhash.query(spark, sf).toPandas().sort_values("doc_id")
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf).collect()}
    prints = [brute_print(texts[d]) for d in got["doc_id"]]
    assert [f"{p:016x}" for p in prints] == got["fingerprint"].tolist()
    x = np.array(prints, np.uint64)
    near, label = np.bitwise_count(x[:, None] ^ x) <= 3, np.arange(len(x))
    while (label != (new := np.array([label[row].min() for row in near]))).any():
        label = new
    assert got["component_id"].tolist() == got["doc_id"].to_numpy()[label].tolist()


def test_near_copies_at_four_fifths(spark, docs):
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(40):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
        copy = words[:]
        for p in rng.sample(range(300), rng.randint(1, 6)):
            copy[p] = f"new{rng.randint(0, 9999)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        a, b = ({tuple(w[j : j + 5]) for j in range(296)} for w in (words, copy))
        pairs.append(len(a & b) / len(a | b) >= 0.8)
    kept = {r["doc_id"] for r in simhash.deduplicate(docs(rows)).collect()}
    assert {2 * i for i in range(40)} <= kept
    assert all((2 * i + 1 not in kept) for i, same in enumerate(pairs) if same) and any(pairs)


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><a href=x>Home</a></header><div id="cookie-notice">We use cookies</div>
<main><div class="post-12"><h1>Title &amp; x</h1><p>One  two<br>three <a href=q>link</a> four<p>five&nbsp;six &#233;<div class="share">Share!</div><script>var a = "</p>";</script>
<ul><li>a<li>b</ul><form>q<input></form><aside>side</aside><!-- gone --></div><section class="comments"><p>reader says very long things and more and more and more</p></section></main><footer>c</footer></body></html>"""


def test_html(spark, sf):
    assert html.Page(PAGE).extract([]) == ("Title & x\nOne two\nthree link four\nfive six é\na\nb", ">html>body.has-sidebar>main>div.post-")
    docs_ = {"\n".join(y for y in (" ".join(x.split()) for x in r["text"].split("\n")) if y) for r in table(spark, sf).collect()}
    got = html.query(spark, sf).collect()
    assert len(got) == table(spark, sf, "pages").count()
    assert sum(r["text"].split("\n", 1)[-1] in docs_ or r["text"] in docs_ for r in got) >= 0.9 * len(got)


STORY = "long words of the article here " * 5


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><h2 id="search-algorithms">Search</h2><p>{STORY}</p><section id="related-work"><h2>Related</h2><p>more</p></section></article>', f"Search\n{STORY.strip()}\nRelated\nmore"),
        (f'<article><p>{STORY}</p><p>Real text <span class="share">Share me</span> goes on.</p></article>', f"{STORY.strip()}\nReal text goes on."),
        (f'<article><p>{STORY} <span class="ad">buy<p>next</span> one</article>', f"{STORY.strip()}\nnext one"),
        (f'<article><p>{STORY}</p><pre><span class="hljs-comment"># note</span> x = 1</pre></article>', f"{STORY.strip()}\n# note x = 1"),
        (f'<div class="sidebar-left"><main><p>{STORY}</p></main></div><div class="sidebar">side</div>', STORY.strip()),
        (f'<div class="sidebar-wrap"><div class="content"><p>{STORY}</p></div></div>', STORY.strip()),
        (f'<article><p>{STORY}</p><div class="relatedPosts"><article>teaser</article></div><div id="cookie-notice">c</div></article>', STORY.strip()),
        (f'<article><p>{STORY}</p><ul class="x-related"><li><a href=1>one</a><li><a>two</a></ul><div id="comments"><p>reader</p></div><section class="comments-area">c</section>', STORY.strip()),
        (f"<article><header><h1>T</h1></header><p>{STORY}</p></article><header>site</header><footer>f</footer>", f"T\n{STORY.strip()}"),
        ("a < b and c > d &lt;x&gt; <3", "a < b and c > d <x> <3"),
        ('<p title="a>b">text</p><!-- x --><!--> y <a href="x', "text\ny"),
    ],
)
def test_html_cases(page, want):
    assert html.Page(page).extract([])[0] == want


@pytest.mark.parametrize("page", ['<a"' * 350_000, '<a"' * 170_000 + ">" + '<a"' * 170_000, '<div class="abc def">' * 100_000 + "x", "<p>" + "<b>" * 100_000 + "</i>" * 100_000, "<p><td>" + "<b>" * 50_000 + "<hr>" * 50_000, "<" * 1_000_000, "<script>" + "</script " * 100_000, "<a ='" * 200_000, "<div class=ad><article>" * 30_000])
def test_html_takes_linear_time(page):
    begin = time.process_time()
    html.Page(page).extract([])
    assert time.process_time() - begin < 15


def test_planted_articles_come_out_whole(spark):
    """Articles in the templates of hosts: what comes out is what went in, block by block."""
    rng = random.Random(6)
    sentence = lambda n: " ".join(rng.choice(["stone", "river", "of", "the", "answer", "related", "search", "comments"]) for _ in range(n))
    parts = ['<nav><a href="/">Home</a></nav>', '<div class="ad">buy now</div>', '<div id="sidebar">most read</div>', '<div class="newsletter-signup">join</div>', '<section class="comments"><p>reader says</p></section>', '<aside>aside</aside>', '<form>q <input></form>', '<footer>foot</footer>', '<div class="cookie-notice">cookies</div>', '<section id="comments"><p>first reader</p></section>']
    frames = [("<article>{}</article>", "h0"), ('<div class="wrap"><div class="entry-content">{}</div></div>', "h1"), ("<main><div>{}</div></main>", "h2"), ('<table><tr><td class="text">{}</td></tr></table>', "h3")]
    pages, want = [], {}
    for i in range(120):
        frame, host = frames[i % 4]
        blocks = [("h1", sentence(4)), *[(rng.choice(["p", "p", "h2", "li", "blockquote"]), sentence(rng.randint(8, 40))) for _ in range(rng.randint(3, 9))]]
        body = "".join(f'<{t} id="{x.split()[0]}">{x.replace("of", "<b>of</b>")}</{t}>' for t, x in blocks)
        around = [p for p in parts if rng.random() < 0.8]
        rng.shuffle(around)
        half = len(around) // 2
        pages.append((i, f"http://{host}.example/{i}", f"<html><body>{''.join(around[:half])}{frame.format(body)}{''.join(around[half:])}</body></html>"))
        want[i] = "\n".join(x for _, x in blocks)
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want


def test_host_consensus(spark):
    """A page whose own best container is another follows the host."""
    body = lambda a, b: f'<body><div class="story">{a}</div><div class="teasers">{b}</div></body>'
    pages = [(i, f"http://h/{i}", body("<p>" + "long words here " * 30 + "</p>", "<p>short</p>")) for i in range(9)] + [(9, "http://h/9", body("<p>brief</p>", "<p>" + "teaser text " * 40 + "</p>"))]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief"


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.query(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    toxic, clean = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert toxic["predicted"].mean() >= 0.55 and clean["predicted"].mean() <= 0.05


def test_label_model_finds_a_bad_voter():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.8, 0.02), (0.7, 0.05), (0.3, 0.3))], 1).astype(np.float32)
    votes = np.c_[votes, votes[:, 0]]  # a copy of the first voter
    gold = np.where(rng.random(4000) < 0.5, y.astype(int), -1)
    posterior, (on, off, weight) = toxicity.label_model(votes, gold, 0.3)
    assert on[0] == pytest.approx(0.8, abs=0.08) and off[0] == pytest.approx(0.02, abs=0.03) and abs(on[2] - off[2]) < 0.1
    assert weight[0] == pytest.approx(0.5, abs=0.1) and weight[3] == pytest.approx(0.5, abs=0.1) and weight[1] > 0.8
    assert ((posterior > 0.5) == y)[gold < 0].mean() > 0.85


def test_leaks(spark, docs):
    sf = "/root/testdata/sf0.01"
    items = {r["item_id"]: decontam.words(r["text"]) for r in table(spark, sf, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.query(spark, sf).collect()}
    want = set()
    for r in table(spark, sf).collect():
        w = decontam.words(r["text"])
        have = set(zip(w, w[1:], w[2:], strict=False))
        for i, x in items.items():
            grams = set(zip(x, x[1:], x[2:], strict=False))
            if grams and len(grams & have) >= 0.8 * len(grams):
                want.add((r["doc_id"], i))
    assert got == want
    rng = random.Random(1)
    text = items[0]
    changed = [w if i % 6 else "other" for i, w in enumerate(text)]
    filler = lambda n: " ".join(f"fill{rng.randint(0, 500)}" for _ in range(n))
    planted = docs([(1, f"{filler(90)} {' '.join(changed)} {filler(50)}"), (2, filler(300)), (3, " ".join(text[: len(text) // 4]))])
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(table(spark, sf).select("doc_id", "text").limit(0).unionByName(planted.select("doc_id", "text")), table(spark, sf, "benchmark")).collect()} == {(1, 0)}


def test_leaks_copied_into_a_third_of_all_rows(spark, docs):
    rng = random.Random(7)
    filler = lambda n: " ".join(f"fill{rng.randint(0, 5000)}" for _ in range(n))
    often = "one passage that very many short rows hold as it is written"
    rows = [(i, often if i % 3 == 0 else filler(40)) for i in range(600)]
    bench = spark.createDataFrame([(0, often), (1, "another item that no row holds"), (2, "passage")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(rows), bench).collect()}
    assert got == {(i, j) for i in range(0, 600, 3) for j in (0, 2)}


@pytest.mark.parametrize("size", [6, 9, 12, 24])
def test_changed_leaks_of_short_items(spark, docs, size):
    rng = random.Random(size)
    draw = lambda n: [f"w{rng.randint(0, 999)}" if i % 3 < 2 else f"often{rng.randint(0, 99)}" for i in range(n)]
    items = [draw(size) for _ in range(100)]
    changed = [[w if i % 3 < 2 else f"other{i}" for i, w in enumerate(x)] for x in items]  # no three words in a row are left
    rows = [(i, " ".join(draw(60 + i % 7) + x + draw(60))) for i, x in enumerate(changed)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(rows), bench).collect()}
    assert len(got & {(i, i) for i in range(100)}) >= 95 and len(got) <= 110


def test_lcs():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(masks, len(a), b) == t[-1][-1]


def test_two_pipelines_at_once(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    one = pipeline.run(spark, sf).select("doc_id", "taken")
    first = sorted(map(tuple, one.collect()))
    two = pipeline.run(spark, sf).select("doc_id", "taken")
    assert sorted(map(tuple, two.collect())) == first == sorted(map(tuple, one.collect()))


def test_pipeline(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact", "simhash", "decontam", "mixing"]
    out = pipeline.run(spark, sf).toPandas()
    docs_ = table(spark, sf)
    labels = table(spark, sf, "labels").where(~common.held_out(F.col("doc_id")))
    left = toxicity.reject(docs_, toxicity.learn(docs_, labels))
    assert left.columns == docs_.columns
    texts = {}
    for r in sorted(left.collect(), key=lambda r: (-len(r["text"]), r["doc_id"])):
        texts.setdefault(SPACE.sub("", r["text"]), r["doc_id"])
    assert set(out["doc_id"]) <= set(texts.values())
    bad = {r["doc_id"] for r in decontam.leaks(docs_, table(spark, sf, "benchmark")).collect()}
    assert not bad & set(out["doc_id"]) and len(out) > 0.6 * docs_.count()
    assert (out["taken"] <= 2 * out["size"]).all()


@pytest.mark.parametrize("copies", [20, 100, 300, 400])
def test_a_leak_in_most_documents(spark, docs, copies):
    rng = random.Random(copies)
    filler = lambda n: " ".join(f"fill{rng.randint(0, 3000)}" for _ in range(n))
    item = " ".join(f"w{rng.randint(0, 500)}" for _ in range(20))
    rows = [(i, f"{filler(40)} {item} {filler(20)}" if i < copies else filler(80)) for i in range(400)]
    bench = spark.createDataFrame([(0, item), (1, "nothing like it at all in there")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(rows), bench).collect()} == {(i, 0) for i in range(copies)}


def test_leaks_of_any_length(spark, docs):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"fill{rng.randint(0, 3000)}" for _ in range(n))
    items = [(m, filler(m)) for m in (1, 2, 5, 8, 15, 16, 17, 50, 200, 600, 2000)]
    rows = [(m, f"{filler(40)} {x} {filler(20)}") for m, x in items] + [(9000 + m, f"{x} {filler(5)}") for m, x in items]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, m) for m, _ in items for d in (m, 9000 + m)} <= got


def test_recall_beside_many_items(spark, docs):
    """4,096 items of 9 to 120 words, one in six words of the planted quarter replaced."""
    g = np.random.default_rng(5)
    draw = lambda n: [f"z{int(x)}" for x in np.minimum(g.zipf(1.25, n), 30000)]
    items, rows = [], []
    for i in range(4096):
        own = draw(int(g.choice([9, 12, 16, 24, 40, 60, 120])))
        items.append((i, " ".join(own)))
        planted = [w if k % 6 != 2 else f"new{i}" for k, w in enumerate(own)] if i % 4 == 0 else []
        rows.append((i, " ".join(draw(80) + planted + draw(60))))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in found for i in range(0, 4096, 4)) >= 0.95 * 1024
