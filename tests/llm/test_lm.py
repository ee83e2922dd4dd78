import math
import os
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import kn, lm, queries

SCHEMA = "doc_id long, text string, lang string"


def plain(train, asked):
    """Interpolated modified Kneser-Ney bigrams with dicts; (n_tokens, n_known, base, score) of each asked text."""
    cut = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    one, two = Counter(), Counter()
    for t in train:
        ws = cut(t)
        one.update(ws)
        two.update(zip(["<s>", *ws], ws))
    n, v = sum(one.values()), len(one)
    stands, total, n1, n2, n3 = Counter(), Counter(), Counter(), Counter(), Counter()
    for (h, w), c in two.items():
        stands[w] += 1
        total[h] += c
        (n1 if c == 1 else n2 if c == 2 else n3)[h] += 1
    dw, dp = kn.discounts(np.array(list(stands.values()))), kn.discounts(np.array(list(two.values())))
    spare = sum(dw[min(c, 3)] for c in stands.values()) / len(two) / (v + 1)
    out = []
    for t in asked:
        ws, base, score = cut(t), 0.0, 0.0
        for h, w in zip(["<s>", *ws], ws):
            base += math.log10((one[w] + 1) / (n + v + 1))
            low = (stands[w] - dw[min(stands[w], 3)]) / len(two) + spare
            if total[h]:
                low = (two[h, w] - dp[min(two[h, w], 3)]) / total[h] + (dp[1] * n1[h] + dp[2] * n2[h] + dp[3] * n3[h]) / total[h] * low
            score += math.log10(low)
        out.append((len(ws), sum(one[w] > 0 for w in ws), base, score))
    return out


def test_documents_against_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = lm.fit(docs, ~held, least_shards=32)
    assert len(model.frequent) > 3
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    rows = docs.collect()
    train = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    better = []
    for r, want in zip(rows, plain(train, [r.text for r in rows])):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known) == want[:2]
        assert math.isclose(g.base_score, want[2], rel_tol=1e-9) and math.isclose(g.score, want[3], rel_tol=1e-6)
        if zlib.crc32(str(r.doc_id).encode()) % 7 == 2:
            better.append(g.score > g.base_score)
    assert sum(better) > 0.8 * len(better)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c", "x"), (2, "a b b", "x"), (3, "c a", "x")], SCHEMA)
    model = lm.fit(docs, F.lit(True))
    words = ["a", "b", "c", "\0unseen"]
    for h in ("a", "b", "c", "zzz"):
        asked = spark.createDataFrame([(i, f"{h} {w}" if w != "</s>" else h, "x") for i, w in enumerate([*words, "</s>"])], SCHEMA)
        arrays = lm.Reader(model)
        total = 0
        for w in [*words, "</s>"]:
            t, sizes = lm.Tokens().of([(f"{h} {w}" if w != "</s>" else h).encode()])
            a, _ = lm.Tokens().of([h.encode()])
            whole = arrays.score(t, sizes)[2][0]
            end = arrays.score(*lm.Tokens().of([h.encode()]))[2][0]
            if w == "</s>":
                first = arrays.score(np.array([a[0]], np.uint64), np.array([1]))[2][0]
                total += 10 ** (end - first)
            else:
                first = arrays.score(np.array([t[0]], np.uint64), np.array([1]))[2][0]
                two = arrays.score(t[:2], np.array([2]))[2][0]
                total += 10 ** (two - first)
        assert abs(total - 1) < 1e-9 and asked.count() == 5 and whole < 0


def test_edges_of_the_domain(spark):
    long = "the cat sat " * 50_000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, "The Dog", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("shard", F.lit(1))
    got = lm.score(docs, lm.fit(docs, F.lit(True))).collect()
    want = plain([t for _, t, _ in rows], [t for _, t, _ in rows])
    for g, w in zip(got, want):
        assert (g.n_tokens, g.n_known) == w[:2] and math.isclose(g.score, w[3], rel_tol=1e-6) and math.isclose(g.base_score, w[2], rel_tol=1e-9)
    assert {(r.base_score, r.score) for r in lm.score(docs, lm.fit(docs, F.lit(False))).collect()} == {(0.0, 0.0)}
    assert lm.score(docs.limit(0), lm.fit(docs.limit(0), F.lit(True))).collect() == []


def test_more_shards_than_a_gather_has_bigrams_and_few_open_files(spark, sf, monkeypatch):
    """Ranges of shards, merged on the way; a reader of any number of shards holds few files open. Counts above 255 are exact."""
    monkeypatch.setattr(lm, "FAN", 8)
    monkeypatch.setattr(lm, "MOST_OPEN", 5)
    monkeypatch.setattr(lm, "GATHER", 3000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").unionByName(spark.createDataFrame([(900, "again and " * 700, "en", "x", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = lm.fit(docs, F.lit(True), least_shards=4000)
    assert model.shards == 4000 and model.distinct < 4000 * 10
    reader, most = lm.Reader(model), 0
    before = len(os.listdir("/proc/self/fd"))
    for t, want in zip(texts.values(), plain(texts.values(), texts.values())):
        tokens, sizes = lm.Tokens().of([(t or "").encode()])
        known, base, score = (x[0] for x in reader.score(tokens, sizes))
        most = max(most, len(os.listdir("/proc/self/fd")) - before)
        assert known == want[1] and math.isclose(base, want[2], rel_tol=1e-9) and math.isclose(score, want[3], rel_tol=1e-6)
    assert most <= 5 + 2


def test_registered_query(spark, sf):
    got = queries.op7_lm_scoring(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    rows, texts = got.collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    train = [t for d, t in texts.items() if not out[d]]
    assert {r.doc_id: r.held_out for r in rows} == out and {r.train_tokens for r in rows} == {sum(len((t or "").encode().split()) + 1 for t in train)}
    want = dict(zip(texts, plain(train, texts.values())))
    assert all((r.n_tokens, r.n_known) == want[r.doc_id][:2] and math.isclose(r.score, want[r.doc_id][3], rel_tol=1e-6) for r in rows)


def test_a_shard_is_opened_once_a_gathering(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = lm.fit(docs, F.lit(True), least_shards=300)
    table, opened, load = docs.toArrow(), Counter(), lm.load
    batches = lambda: (table.slice(i, 10).combine_chunks().to_batches()[0] for i in range(0, table.num_rows, 10))
    monkeypatch.setattr(lm, "load", lambda folder, name, kinds: (opened.update([name]), load(folder, name, kinds))[1])
    whole = [r for b in lm.scored(batches(), lm.Reader(model)) for r in b.to_pylist()]
    assert len(opened) > 2 * lm.MOST_OPEN
    contexts_then_bigrams = 2  # a bigram shard is read for its contexts, then for its counts
    assert max(opened.values()) <= contexts_then_bigrams
    monkeypatch.setattr(lm, "SCORE_TOKENS", 1)
    assert [r for b in lm.scored(batches(), lm.Reader(model)) for r in b.to_pylist()] == whole
    assert max(opened.values()) > 10
