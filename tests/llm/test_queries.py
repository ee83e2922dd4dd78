"""Registered queries of the smallest table: columns, types, one row a document, and what brute force says of op1 to op4."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, queries
from tests.llm.test_pii import plain
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_token_count import greedy


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_every_operator_has_one_query_and_no_other():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_op1(spark, sf):
    got = queries.op1_simhash_near_dedup(spark, sf)
    assert got.dtypes[:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    fps = {d: slow_fingerprint(t) for d, t in texts_of(spark, sf).items()}
    groups, least = slow_components(set(fps.values()), 2), {}
    for d in sorted(fps):
        least.setdefault(groups[fps[d]], d)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == {d: (f"{f:016x}", least[groups[f]]) for d, f in fps.items()}


def test_op2(spark, sf):
    got = queries.op2_decontamination(spark, sf)
    assert got.columns == ["doc_id", "contaminated", "n_items", "item_ids"]
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(texts_of(spark, sf)) and all(r.contaminated == bool(r.item_ids) and r.n_items == len(r.item_ids) for r in rows)


def test_op3(spark, sf):
    got = queries.op3_token_counts(spark, sf)
    texts, vocabulary = texts_of(spark, sf), bpe.ranks(public_tokenizers.path(bpe.RANKS))[0]
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == set(texts)
    for d in sorted(texts)[:40]:
        words = texts[d].encode().split()
        assert (rows[d].n_words, rows[d].n_tokens) == (len(words), sum(greedy(b" " + w, vocabulary, max(map(len, vocabulary))) for w in words))


def test_op4(spark, sf):
    got = queries.op4_pii(spark, sf)
    assert dict(got.dtypes).items() >= {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}, "base_sha256": "string", "spans": "string"}.items()
    texts = texts_of(spark, sf)
    for r in got.collect():
        base = plain(texts[r.doc_id])
        assert {k: r[f"n_{k}"] for k in ("email", "ip", "card", "phone")} == {k: sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")}
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(told.split(",")) - {""} <= set(r.spans.split(","))


def test_extra_columns_do_not_matter(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30")
    for extra in ("fingerprint", "component_id", "n_email", "spans", "kind", "start"):
        docs = docs.withColumn(extra, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for f in (queries.op1_simhash_near_dedup, queries.op4_pii, queries.op5_byte_bpe, queries.op7_lm_scoring, queries.op9_language_id):
        assert f(spark, str(tmp_path)).count() == 30
