import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import kn, queries, toxicity


class PlainKN:
    """Interpolated modified Kneser-Ney over symbol tuples, written out with dicts."""

    def __init__(self, counts, shared, order):
        self.order, self.tables = order, {order: counts}
        for k in range(order - 1, 0, -1):
            lower = {}
            for g in shared if k == order - 1 else self.tables[k + 1]:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            self.tables[k] = lower
        self.d = {k: kn.discounts(np.array(list(t.values()))) for k, t in self.tables.items()}

    def p(self, gram):
        out = 1 / 1024
        for k in range(1, self.order + 1):
            g = gram[-k:]
            around = {x: c for x, c in self.tables[k].items() if x[:-1] == g[:-1]}
            if around:
                d, total = self.d[k], sum(around.values())
                own = around.get(g, 0)
                out = (own - d[min(own, 3)]) / total + sum(d[min(c, 3)] for c in around.values()) / total * out
        return out


def grams(words, order):
    out = []
    for w in words:
        s = [0] * (order - 1) + [1 + (ord(c) - 1) % 1023 for c in w] + [0]
        out.append([tuple(s[i : i + order]) for i in range(len(s) - order + 1)])
    return out


def test_models_equal_plain_kneser_ney():
    one, other, order = ["abba", "abc", "cab", "abc", "aé"], ["bad", "badly", "abc"], 3
    count = lambda ws: {g: sum(x.count(g) for x in grams(ws, order)) for x in grams(ws, order) for g in x}
    shared = {**count(one), **count(other)}
    plain = [PlainKN(count(x), shared, order) for x in (one, other)]
    packed = []
    for ws in (one, other):
        g, _ = kn.pack(ws, order)
        packed.append((g, np.ones(len(g), np.int64)))
    model = kn.PairModel(*packed, order=order)
    asked = ["abc", "badge", "", "zé", "abcabc"]
    want = [sum(math.log(plain[1].p(g)) - math.log(plain[0].p(g)) for g in gs) for gs in grams(asked, order)]
    assert np.allclose(model.log_ratio(asked), want, atol=1e-5)


def test_probabilities_sum_to_one():
    g, _ = kn.pack(["abba", "abc", "cab", "abc"], 3)
    model = kn.CharModel(g, np.ones(len(g), np.int64), order=3)
    for context in ((0, 0), (0, 98), (99, 98), (5, 5)):
        keys = np.array([(context[0] << 20) | (context[1] << 10) | s for s in range(1024)], np.uint64)
        assert abs(model.probabilities(keys).sum() - 1) < 1e-4


def test_held_out_accuracy(spark):
    # 40 training texts or so for each language but English; larger tables give full recall
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = toxicity.score(docs, toxicity.fit(docs, labels, ~held)).join(labels, "doc_id").where(held).join(docs.select("doc_id", "lang"), "doc_id").select("toxic", "score", "lang").collect()
    pred = [(r.toxic, r.score >= toxicity.THRESHOLD) for r in got]
    assert sum(y for y, _ in pred) > 30
    assert sum(p for y, p in pred if y) >= 0.9 * sum(y for y, _ in pred)
    assert sum(p for y, p in pred if not y) <= 0.01 * sum(not y for y, _ in pred)
    for lang in ("en", "de", "fr", "es"):
        own = [r.score >= toxicity.THRESHOLD for r in got if r.toxic and r.lang == lang]
        assert len(own) > 10 and sum(own) >= 0.9 * len(own), lang


def plain_scores(texts, labels, folds):
    """The scores by plain Kneser-Ney models over dicts. texts: by id; labels: 0 or 1 by id; folds: by id."""
    words = {d: toxicity.letters((t or "").encode()) for d, t in texts.items()}

    def count(ids):
        out = {}
        for d in ids:
            for gs in grams([w.decode() for w in words[d]], toxicity.ORDER):
                for g in gs:
                    out[g] = out.get(g, 0) + 1
        return out

    def figure(ids):
        ordinary, toxic = (count(i for i in ids if labels[i] == c) for c in (0, 1))
        shared = {**ordinary, **toxic}
        a, b = PlainKN(ordinary, shared, toxicity.ORDER), PlainKN(toxic, shared, toxicity.ORDER)
        known = {}

        def of(w):
            if w not in known:
                known[w] = sum(math.log(b.p(g)) - math.log(a.p(g)) for g in grams([w.decode()], toxicity.ORDER)[0])
            return known[w]

        def whole(d):
            total = sum(math.log(1 - toxicity.SHARE + toxicity.SHARE * math.exp(of(w))) for w in words[d])
            return math.log(max(0, total) / max(1, len(words[d])) ** toxicity.NORM + toxicity.FLOOR)

        return whole

    seen = {}
    for f in sorted(set(folds.values())):
        whole = figure([d for d in labels if folds[d] != f])
        seen |= {d: whole(d) for d in labels if folds[d] == f}
    ids = sorted(labels)
    slope, base = toxicity.curve_of(np.array([seen[d] for d in ids]), np.array([labels[d] for d in ids]), {0: 1.0, 1: 1.0})
    whole = figure(list(labels))
    return {d: 1 / (1 + math.exp(-(slope * whole(d) + base))) for d in texts}


def test_the_bar_stands_in_the_gap_or_where_the_cost_is_least():
    assert toxicity.bar_of(np.array([0.0, 1.0]), np.array([3.0, 4.0])) == 2.0
    rng = random.Random(2)
    for _ in range(30):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(1, 20))] for _ in range(2))
        cost = lambda bar: toxicity.ALARM_COST * sum(x >= bar for x in a) / len(a) + sum(x < bar for x in b) / len(b)  # noqa: B023, E731
        places = [x + 0.5 for x in range(12)]
        assert cost(toxicity.bar_of(np.array(a, float), np.array(b, float))) <= min(map(cost, places)) + 1e-9


def test_registered_query_against_plain_models(spark, tmp_path):
    rng = random.Random(4)
    common, foul = ["good", "day", "to", "all", "goods", "daily"], ["idiot", "idiots", "scum"]
    texts, labels = {}, {}
    for d in range(60):
        labels[d] = int(d % 3 == 0)
        texts[d] = " ".join(rng.choice(foul if labels[d] and rng.random() < 0.4 else common) for _ in range(rng.randint(1, 8)))
    texts |= {60: None, 61: "", 62: "an idiotic day", 63: "SCUM"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    frames = {"documents": docs, "labels": spark.createDataFrame([(d, 1, t) for d, t in labels.items()], "doc_id long, quality int, toxic int").coalesce(1)}
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.op8_toxicity(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    out = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in texts}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(2_000_000)) % toxicity.FOLDS
    folds = {r.doc_id: r.f for r in docs.select("doc_id", draw.alias("f")).collect()}
    want = plain_scores(texts, {d: t for d, t in labels.items() if not out[d]}, {d: f for d, f in folds.items() if d in labels and not out[d]})
    rows = got.collect()
    assert len(rows) == 64
    for r in rows:
        assert r.held_out == out[r.doc_id] and r.predicted == (r.score >= 0.3) and math.isclose(r.score, want[r.doc_id], abs_tol=1e-3)


def test_edges_of_the_domain(spark):
    long = "good day " * 40_000
    rows = [(i, "you foul idiot thing" if i % 2 else "a good day to all", "x") for i in range(40)]
    rows += [(90, None, "x"), (91, "", "x"), (92, long, "x"), (92, long, "x"), (None, "idiot", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(5)).withColumn("fold", F.lit(5))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(1, 0, 0), (2, 1, None), (None, 1, 1), (3, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    by = dict(got)
    assert len(got) == 45 and all(0 <= s <= 1 for _, s in got)
    assert by[1] > 0.5 > by[2] and by[90] == by[91] < 0.5 and by[92] < 0.3 and by[None] > 0.3
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in got if s < 0.3}
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []
