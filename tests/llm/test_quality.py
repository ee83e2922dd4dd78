import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import kn, lm, quality, queries
from tests.llm.test_toxicity import PlainKN, grams


def test_perplexity_equals_the_plain_model(spark):
    words = ["abba", "abc", "cab", "Éa", "abc"]
    g, _ = kn.pack(words, 5)
    model = kn.CharModel(g, np.ones(len(g), np.int64), order=5)
    counts = {}
    for x in (y for gs in grams(words, 5) for y in gs):
        counts[x] = counts.get(x, 0) + 1
    plain = PlainKN(counts, counts, 5)
    docs = spark.createDataFrame([(1, "abc Éab  zz", "x")], "doc_id long, text string, lang string")
    logs = [math.log(plain.p(x)) for gs in grams(["abc", "Éab", "zz"], 5) for x in gs]
    assert math.isclose(quality.perplexities(docs, model).first().perplexity, math.exp(-sum(logs) / len(logs)), rel_tol=1e-4)


def test_joined_counts_give_every_gram_its_probability(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, _ = quality.fit(docs, labels)
    words = sorted({w.decode() for r in docs.select("text").collect() for w in (r.text or "").encode().split()})
    grams = np.unique(kn.pack(words, model.order)[0])
    folder, shards = quality._gram_shards(docs, model)
    got = {}
    for s in range(shards):
        try:
            keys, p = lm.load(folder, f"score-{s}", lm.FILES["score"])
        except FileNotFoundError:
            continue
        assert (quality._shard(np.array(keys), shards) == s).all()
        got.update(zip(keys.tolist(), p.tolist()))
    assert sorted(got) == grams.tolist()
    assert np.allclose([got[g] for g in grams.tolist()], model.probabilities(grams), rtol=1e-6)


def test_trusted_texts_pass_and_noise_does_not(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg("passes").alias("p"), F.count(F.lit(1)).alias("n"))
    share = {r.quality: r.p for r in got.collect()}
    assert share[1] > 0.985 and share[0] < 0.35


def test_edges_of_the_domain(spark):
    long = "a good day " * 40_000
    rows = [(i, f"a good day to all of you number {'abcdefghij'[i % 10]}", "en") for i in range(200)]
    rows += [(900, None, "en"), (901, " ", "en"), (902, long, "en"), (902, long, "en"), (None, "a good day", None), (903, "###&&& ***", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("perplexity", F.lit("x")).withColumn("n", F.lit("x"))
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 206 and by[900].perplexity is None and by[901].passes == 0 and by[903].passes == 0
    assert by[902].perplexity > 1 and sum(r.passes for r in got if r.doc_id is not None and r.doc_id < 200) > 190
    none = quality.classify(docs, labels.limit(0)).collect()
    assert len(none) == 206 and not any(r.passes for r in none)
    assert quality.classify(docs.limit(0), labels).collect() == []


def plain_classes(docs, trusted, trained, least, quantiles):
    """(perplexity, passes) by id: plain Kneser-Ney over dicts, quantiles by rank."""
    counts = {}
    for d in trained:
        for gs in grams([w for w in (docs[d][0] or "").split()], quality.ORDER):
            for g in gs:
                counts[g] = counts.get(g, 0) + 1
    plain, known = PlainKN(counts, counts, quality.ORDER), {}

    def logs(w):
        if w not in known:
            known[w] = sum(math.log(plain.p(g)) for g in grams([w], quality.ORDER)[0])
        return known[w]

    perplexity = {}
    for d, (t, _) in docs.items():
        ws = (t or "").split()
        perplexity[d] = math.exp(-sum(map(logs, ws)) / (sum(map(len, ws)) + len(ws))) if ws else None
    at = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]
    judged = [d for d in trusted if d not in trained and perplexity[d] is not None]
    out = {}
    for d, (_, lang) in docs.items():
        own = [perplexity[x] for x in judged if docs[x][1] == lang]
        xs = own if lang and len(own) >= least else [perplexity[x] for x in judged]
        low, high = (at(xs, q) for q in quantiles)
        out[d] = (perplexity[d], low, high, int(perplexity[d] is not None and low * (1 - 1e-6) <= perplexity[d] <= high * (1 + 1e-6)), lang if lang and len(own) >= least else None)
    return out


def test_classes_against_plain_models_and_quantiles(spark):
    rng = random.Random(12)
    words = {"en": ["cat", "hat", "sat", "mat"], "de": ["und", "hund", "bund"]}
    docs, trusted = {}, set()
    for d in range(120):
        lang = rng.choice(["en", "en", "en", "de"])
        docs[d] = (" ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 6))), lang)
        if d % 5:
            trusted.add(d)
    docs |= {120: ("zq qz", "en"), 121: (None, "en"), 122: ("cat", None), 123: ("und", "fr")}
    df = spark.createDataFrame([(d, *x) for d, x in docs.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d in trusted] + [(0, 0)], "doc_id long, quality int")
    draws = {r.doc_id: r.x for r in df.select("doc_id", quality._draw().alias("x")).collect()}
    trained = {d for d in trusted if draws[d] < 0.5 * quality._DRAW}
    want = plain_classes(docs, trusted, trained, 20, (0.05, 0.95))
    got = quality.classify(df, labels, (0.05, 0.95), least_trusted=20).collect()
    assert len(got) == len(docs) and {r.bounds_of for r in got} == {"en", None}
    for r in got:
        p, low, high, passes, of = want[r.doc_id]
        assert (r.passes, r.bounds_of) == (passes, of) and math.isclose(r.least, low, rel_tol=1e-4) and math.isclose(r.most, high, rel_tol=1e-4)
        assert r.perplexity is None if p is None else math.isclose(r.perplexity, p, rel_tol=1e-4)


def test_registered_query(spark, sf):
    got = queries.op6_quality(spark, sf)
    assert got.columns == ["doc_id", "perplexity", "least", "most", "passes", "bounds_of"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_the_model_counts_every_trained_document(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    rows = [(i, f"{name()} {name()}") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(12_000)], "doc_id long, quality int")
    model, share = quality.fit(docs, labels)
    chosen = {r.doc_id for r in docs.where(quality._draw() < 0.5 * quality._DRAW).select("doc_id").collect()}
    assert share == 0.5 and len(chosen) > 5_500  # more than the 4,000 that a bound once left
    grams, _ = kn.pack([w for i, t in rows if i in chosen for w in t.split()], quality.ORDER)
    plain = kn.CharModel(grams, np.ones(len(grams), np.int64), order=quality.ORDER)
    asked = np.unique(kn.pack([w for _, t in rows for w in t.split()] + ["xyz", "aé"], quality.ORDER)[0])
    assert np.allclose(model.probabilities(asked), plain.probabilities(asked), rtol=1e-5)


def test_texts_that_the_model_does_not_learn_from_are_dropped_before_the_join(spark):
    rows = [(i, f"text {i}") for i in range(20_000)] + [(7, "again"), (None, "no id"), (14, None)]
    trusted = set(range(0, 20_000, 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in trusted)) for i in range(20_000)] + [(None, 1)], "doc_id long, quality int")
    for kind in ("long", "string"):
        d, own = docs.withColumn("doc_id", F.col("doc_id").cast(kind)), labels.withColumn("doc_id", F.col("doc_id").cast(kind))
        mine = quality._draw() < quality.TRAINED * quality._DRAW
        ids = own.where(mine & (F.col("quality") == 1)).where("doc_id is not null").select("doc_id")
        want = sorted(r.text for r in d.join(ids, "doc_id").where("text is not null").collect())
        kept = [r.text for r in quality._sieved(d, ids).collect()]
        assert set(want) <= set(kept) and len(kept) < 1.02 * len(want)  # of 20,003
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert sorted(r.text for r in quality._texts(d, own).collect()) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert quality._sieved(docs, ids.limit(0).withColumn("doc_id", F.col("doc_id").cast("long"))).count() == 0
