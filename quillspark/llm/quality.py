"""Quality by the perplexity of a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney model over the characters of words, counted in Spark on trusted texts
(quality label 1). Its counts are tables, one of shares and one of backoff weights for each order, never a broadcast object:
the distinct n-grams of all texts are joined with the counts order by order, and their probabilities go into shards of
sorted arrays in the shared folder, where a document's n-grams are looked up for its perplexity.
A join broadcasts what is bounded by the alphabet (contexts of up to one symbol, shares of one); of the rest the planner
broadcasts what its statistics prove small, and shuffles the shards of what isn't. A document passes if its perplexity lies between
two quantiles of its language, taken over all trusted documents that the model was not trained on: above are noise and
foreign matter, far below are texts made of a few frequent words.

The model is trained on half of the trusted documents, drawn by a hash of their id, all of their text; the other half gives the
bounds, which texts that the model has seen can't. Its counts stay in tables from the first to the last. Languages with fewer than `least_trusted` such documents, and rows without lang, use the
quantiles over all languages; `bounds_of` says which. Quantiles are values of the documents whose rank is off by 1/10,000 of
their number at most (exact up to 10,000 documents), in memory that does not grow with it.

Nulls and edges: a null or empty text has no perplexity and doesn't pass; texts of any length are read whole; a document
is trusted if all its labels say 1; repeated rows give repeated results; doc_id is carried as it is; without trusted
documents nothing has a perplexity and nothing passes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import lm
from quillspark.llm.common import discard, materialize, new_folder, raw_texts, slices, tidied
from quillspark.llm.kn import BITS, CharModel, WordCache, discounts_of, gram_counts, log_by_word, pack

ORDER, QUANTILES, LEAST_TRUSTED = 5, (0.001, 0.995), 50
#: Distinct words that a task gathers before it cuts them, and distinct n-grams before it sends them.
GATHER_WORDS, GATHER_GRAMS = 300_000, 4_000_000
_DRAW = 2_000_000
#: The share of trusted documents that the model learns from; the rest gives the bounds.
TRAINED = 0.5
#: Bits by which texts are told from those of the model before a join: 4 MB at most.
SIEVE = 1 << 25


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def _draw():
    return F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(_DRAW))


@dataclass
class TableModel:
    """A model whose counts are tables: ((gram, share), (context, backoff)) of each order."""

    levels: list[tuple[DataFrame, DataFrame]]
    order: int = ORDER

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Those of some n-grams, for comparisons."""
        distinct, back = np.unique(grams, return_inverse=True)
        asked = self.levels[0][0].sparkSession.createDataFrame(pa.table({"gram": distinct.view(np.int64)}))
        found = _probabilities(asked, self.levels).orderBy("gram").toArrow()
        return found.column("p").to_numpy()[back]


def _sieved(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that may have one of the ids: all that have, and few others as long as there are far fewer ids than bits. Each id sets the
    bit of its hash; the bits are at most 1,024 rows of 4 KB and are broadcast, whatever the number of ids."""
    at = F.pmod(F.xxhash64("doc_id", F.lit("sieve")), F.lit(SIEVE))
    part, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bits = ids.select(part.alias("_part"), bit.alias("_bit")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("_part", part).join(F.broadcast(bits), "_part")
    return found.where(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*docs.columns)


def _texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text): of the trusted documents that the model learns from. Other texts are dropped before the join, which shuffles what is left where
    there are too many ids to broadcast."""
    mine = _draw() < TRAINED * _DRAW
    ids = materialize(_trusted(labels).where(mine), "trusted")
    return _sieved(docs.select("doc_id", "text").where(mine & F.col("text").isNotNull()), ids).join(ids, "doc_id").select("text")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[TableModel | None, float]:
    """(model, share): the model, and the share of trusted documents that it was trained on, the lowest by _draw()."""
    grams = materialize(gram_counts(_texts(docs, labels), [], bytes.split, ORDER), "grams")
    return (TableModel(_levels(grams)), TRAINED) if grams.head(1) else (None, 0.0)


def _levels(grams: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The tables of each order from the counts (gram, n) of the highest: lower n-grams count the contexts of one more symbol that they
    stand in."""
    out = []
    for k in range(ORDER, 0, -1):
        of = {r.n: r["count"] for r in grams.where("n <= 4").groupBy("n").count().collect()}
        d = discounts_of(*(of.get(i, 0) for i in (1, 2, 3, 4)))
        less = F.when(F.col("n") == 1, float(d[1])).when(F.col("n") == 2, float(d[2])).otherwise(float(d[3]))
        counted = grams.select("gram", "n", less.alias("less"), F.shiftright("gram", BITS).alias("context"))
        totals = materialize(counted.groupBy("context").agg(F.sum("n").alias("total"), F.sum("less").alias("less")), "contexts")
        shared = counted.join(F.broadcast(totals.drop("less")) if k <= 2 else totals.drop("less"), "context")
        share = materialize(shared.select(F.col("gram").alias("s_gram"), ((F.col("n") - F.col("less")) / F.col("total")).alias(f"s{k}")), "shares")
        out.append((share, totals.select("context", (F.col("less") / F.col("total")).alias(f"b{k}"))))
        if k > 1:
            lower = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))
            higher, grams = grams, materialize(grams.groupBy(lower.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
            discard(higher)
    return out[::-1]


def _shard(grams: np.ndarray, shards: int) -> np.ndarray:
    return (lm.mixed(grams, 1) % np.uint64(shards)).astype(np.int32)


def _distinct_grams(docs: DataFrame, order: int) -> DataFrame:
    """(gram): the distinct n-grams of the highest order in all texts; a task sends each of its own once, or, beyond
    GATHER_GRAMS of them, once for so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = np.zeros(0, np.uint64), set()
        sent = lambda grams: pa.record_batch([pa.array(grams.view(np.int64))], ["gram"])

        def cut() -> np.ndarray:
            own = [w.decode("utf-8", "replace") for w in words]
            words.clear()
            parts = [np.unique(pack(own[i : i + GATHER_WORDS], order)[0]) for i in range(0, len(own), GATHER_WORDS)]
            return np.unique(np.concatenate([held, *parts]))

        for batch in slices(batches, "text"):
            for text in raw_texts(batch.column("text")):
                words.update(text.split())
            if len(words) >= GATHER_WORDS:
                held = cut()
            if len(held) >= GATHER_GRAMS:
                yield sent(held)
                held = np.zeros(0, np.uint64)
        yield sent(cut())

    return docs.select("text").mapInArrow(tidied(run), "gram long").distinct()


def _counts(spark: SparkSession, model: TableModel | CharModel) -> list[tuple[DataFrame, DataFrame]]:
    """((gram, share), (context, backoff)) of each order. A model that is at hand as arrays gets files of its own, so that the planner
    knows each table's size."""
    if isinstance(model, TableModel):
        return model.levels
    shares, backs = new_folder(spark, "shares"), new_folder(spark, "backoffs")
    for path, names in ((shares, ["grams", "share"]), (backs, ["contexts", "backoff"])):
        each = [[getattr(x, n) for n in names] for x in model.levels]
        k = np.concatenate([np.full(len(keys), k, np.int32) for k, (keys, _) in enumerate(each, 1)])
        keys, values = (np.concatenate(x) for x in zip(*each))
        rows = pa.table({"k": k, "key": keys.view(np.int64), "value": values.astype(np.float64)})
        spark.createDataFrame(rows).write.partitionBy("k").parquet(path)
    read = lambda path, k, *names: spark.read.schema("key long, value double").parquet(f"{path}/k={k}").toDF(*names)
    return [(read(shares, k, "s_gram", f"s{k}"), read(backs, k, "context", f"b{k}")) for k in range(1, model.order + 1)]


def _probabilities(grams: DataFrame, counts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, p) of distinct n-grams, interpolated from the lowest order up."""
    out, p = grams, F.lit(1 / (1 << BITS))
    for k, (share, back) in enumerate(counts, 1):
        own = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        out = out.join(F.broadcast(back) if k <= 2 else back, F.shiftright(own, BITS) == F.col("context"), "left").drop("context")
        out = out.join(F.broadcast(share) if k == 1 else share, own == F.col("s_gram"), "left").drop("s_gram")
        p = F.coalesce(f"b{k}", F.lit(1.0)) * p + F.coalesce(f"s{k}", F.lit(0.0))
    return out.select("gram", p.alias("p"))


def _gram_shards(docs: DataFrame, model: TableModel | CharModel) -> tuple[str, int]:
    """(folder, shards): the probability of each n-gram in the texts, written as shards of arrays sorted by n-gram."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 15, size >> 28) if size < 1 << 60 else 0)
    folder = new_folder(spark, "gram-shards")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _shard(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), shards)
            yield pa.record_batch([pa.array(at), *batch.columns], ["shard", "gram", "p"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            at, grams, p = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s in np.unique(at).tolist():
                found.setdefault(s, []).append((grams[at == s].view(np.uint64), p[at == s]))
        for s, parts in found.items():
            grams, p = (np.concatenate(x) for x in zip(*parts))
            by = np.argsort(grams)
            lm.save(folder, f"score-{s}", grams[by], p[by])
            yield pa.record_batch([pa.array([len(grams)])], ["n"])

    known = _probabilities(_distinct_grams(docs, model.order), _counts(spark, model)).mapInArrow(deal, "shard int, gram long, p double")
    discard(materialize(known.repartitionById(shards, F.col("shard")).mapInArrow(tidied(write), "n long"), "gram-shards"))
    return folder, shards


def perplexities(docs: DataFrame, model: TableModel | CharModel | None) -> DataFrame:
    """(doc_id, lang, perplexity): one row a document."""
    kinds = {n: docs.schema[n].dataType.simpleString() for n in ("doc_id", "lang")}
    folder, shards = _gram_shards(docs, model) if model else ("", 0)
    order = model.order if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = lm.Reader(lm.Model(folder))

        def looked_up(grams: np.ndarray) -> np.ndarray:
            p = np.full(len(grams), np.nan)
            for s, own, at in reader.each(grams, _shard(grams, shards), "score"):
                p[own] = reader.arrays("score", s)[1][at]
            if np.isnan(p).any():
                raise RuntimeError("the texts changed while they were scored")
            return p

        cache = WordCache(lambda words: log_by_word(looked_up, words, order)) if shards else None
        for batch in slices(batches, "text"):
            out: list[float | None] = [None] * batch.num_rows
            if cache:
                words = [t.split() for t in raw_texts(batch.column("text"))]
                for i, (ws, logs) in enumerate(zip(words, cache.of(words))):
                    if ws:
                        code_points = int((np.frombuffer(b"".join(ws), np.uint8) & 0xC0 != 0x80).sum())
                        out[i] = float(np.exp(-logs.sum() / (code_points + len(ws))))
            yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.float64())], ["doc_id", "lang", "perplexity"])

    return docs.select("doc_id", "lang", "text").mapInArrow(tidied(run), f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantiles: tuple[float, float] = QUANTILES, least_trusted: int | None = None) -> DataFrame:
    """(doc_id, perplexity, least, most, passes, bounds_of): passes is 1 if the perplexity lies within the bounds of its
    language (bounds_of is that), or of all (null)."""
    model, share = fit(docs, labels)
    scored = materialize(perplexities(docs, model), "quality")
    judged = scored.join(_trusted(labels).where(_draw() >= share * _DRAW), "doc_id").where("perplexity is not null")
    bounds = F.percentile_approx("perplexity", F.array(*map(F.lit, quantiles)), 10_000).alias("q")
    whole = judged.agg(bounds).first()["q"]
    by_lang = judged.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), bounds).where(F.col("n") >= (LEAST_TRUSTED if least_trusted is None else least_trusted))
    own = materialize(by_lang.select("lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")), "bounds")
    least, most = (F.coalesce(c, F.lit(w).cast("double")) for c, w in zip(("low", "high"), whole or (None, None)))
    found = scored.join(own, "lang", "left").select("doc_id", "perplexity", least.alias("least"), most.alias("most"), F.when(F.col("low").isNotNull(), F.col("lang")).alias("bounds_of"))
    return found.withColumn("passes", F.coalesce(F.col("perplexity").between(F.col("least"), F.col("most")), F.lit(False)).cast("int")).select("doc_id", "perplexity", "least", "most", "passes", "bounds_of")
