"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontam, pii, simhash, toxicity
from quillspark.llm.common import materialize, table
from quillspark.llm.queries import held_out

#: Words a fingerprint's shingle, and differing bits up to which two documents are candidates, in any of some independent
#: tables of fingerprints. Of the pairs whose 5-word shingles are 0.8 to 1 similar, one such table links 38 % at sf0.1 and 44 %
#: of those of a sample of check_s, eight 92 % and 98 %, ten 98 % and 98 % (3-word fingerprints in ten tables: 88 % and 91 %). A wider
#: radius would need shards without a size bound.
NEAR_WORDS, NEAR_BITS, NEAR_TABLES = 2, 4, 10
#: Jaccard similarity of 5-word shingles from which a candidate is a near copy.
SIMILAR = 0.8


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labels that op8_toxicity learns from."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(4)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are near copies, checked exactly, of one that stays."""
    return simhash.keep_unlike(docs, SIMILAR, width=NEAR_WORDS, radius=NEAR_BITS, tables=NEAR_TABLES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars follows."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and what they decode to."""
    return bpe.tokenize(docs, public_tokenizers.path(bpe.RANKS))


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", mask_personal_data), ("byte_bpe", encode)]

#: SQL has neither the hashes nor the models of these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
