import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, queries


def plain_bundle(text):
    """Binding and bundling of one text, trigram by trigram."""
    v = np.random.default_rng(langid.SEED).integers(0, 2, (langid.SYMBOLS, langid.DIMENSIONS), np.int8) * 2 - 1
    out, word = np.zeros(langid.DIMENSIONS), [0]
    for c in text.lower():
        s = 1 + ord(c) % (langid.SYMBOLS - 1) if c.isalpha() else 0
        if s or word[-1]:
            word.append(s)
    word += [0] if word[-1] else []
    for a, b, c in zip(word, word[1:], word[2:]):
        out += np.roll(v[a], 2).astype(int) * np.roll(v[b], 1) * v[c]
    return out / max(1e-9, np.linalg.norm(out))


def test_bundles_equal_plain_binding():
    texts = ["The cat, the hat", "a", "", None, "123 --", "Über straße ÉÈ", "x" * 400]
    got, lettered = langid.bundles(texts)
    assert lettered.tolist() == [True, True, False, False, False, True, True]
    for t, v in zip(texts, got):
        if t and any(c.isalpha() for c in t):
            assert np.allclose(v, plain_bundle(t), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = langid.predict(docs, langid.fit(docs, ~held)).join(docs.where(held).select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count(F.lit(1))).first()
    assert n > 150 and right > 0.97


def test_edges_of_the_domain(spark):
    long = "the cat and the dog " * 20_000
    rows = [(1, None, "en"), (2, "", "de"), (3, long, "en"), (3, long, "en"), (None, "der hund und die katze", "de"), (4, "the cat", None), (5, "12 34", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    got = langid.predict(docs, langid.fit(docs, F.lit(True))).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "en", "en", "de", "en", "und"]
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == 0
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0), F.lit(True))).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs, F.lit(False))).collect()} == {"und"}


def test_registered_query_against_plain_prototypes(spark, tmp_path):
    kinds = {"en": ["the", "cat", "hat", "that"], "de": ["der", "hund", "und", "über"], "xx": ["zzyx", "qxz"]}
    rng, rows = random.Random(3), []
    for d in range(80):
        lang = rng.choice(list(kinds))
        rows.append((d, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 12))), lang))
    rows += [(80, None, "en"), (81, "12 -", "de"), (82, "the über cat", None), (83, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    sums = {}
    for d, t, lang in rows:
        if not out[d] and lang and t is not None:
            sums[lang] = sums.get(lang, 0) + plain_bundle(t)
    prototypes = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    got = queries.op9_language_id(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        r = got[d]
        assert r.held_out == out[d]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {k: float(plain_bundle(t) @ v) for k, v in prototypes.items()}
        best = max(cosine.values())
        assert abs(r.score - min(1, max(0, best))) < 1e-4 and cosine[r.lang_pred] > best - 1e-4


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(True))
