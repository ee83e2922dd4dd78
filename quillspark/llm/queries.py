"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontam, divergence, langid, lm, pii, quality, repeats, sql_twins, token_count, topk, toxicity, veccode
from quillspark.llm.common import table
from quillspark.llm.simhash import near_duplicates


def held_out(modulus: int) -> Column:
    """Rows whose crc32(doc_id as text) leaves 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.fit(docs, ~held_out(7))
    found = lm.score(docs, model)
    return found.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(4)))
    return found.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, ~held_out(4)))
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccode.compress(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_QUERIES = [op1_simhash_near_dedup, op2_decontamination, op3_token_counts, op4_pii, op5_byte_bpe, op6_quality, op7_lm_scoring, op8_toxicity, op9_language_id, op10_exact_topk, op11_vector_codes, op12_suffix_dedup, op13_source_divergence]
_ORACLE: dict[str, str] = {
    "op11_vector_codes": sql_twins.vector_codes(),
    "op13_source_divergence": sql_twins.SOURCE_DIVERGENCE,
    "op10_exact_topk": """
WITH u AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS score
  FROM u q JOIN u c ON c.r <> q.r AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM p
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE k <= 5
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
