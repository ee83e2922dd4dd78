"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is bound into one vector as the product of the first
letter's vector shifted twice, the second's shifted once and the third's; what isn't a letter is a word boundary, one
symbol of its own. A text is the bundle (sum) of its trigrams' vectors, a language the bundle of its training texts, each
at length 1. The prediction is the language whose prototype has the largest cosine with the text, of equal ones the first
by name; the score is that cosine, cut to 0..1.

Prototypes are learned from a hash sample of at most about `per_lang` texts of each language (a documented bound), chosen
by doc_id only; the vectors come from a fixed seed.

Nulls and edges: a null text, or one without a letter, is `und` with score 0; texts of any length are read whole; rows
without lang are predicted but never learned from; repeated rows give repeated results; doc_id is carried as it is, a null
id counts as training if chosen; more than MOST_LANGS languages are an error; with nothing to learn from all are `und`; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import slices, tidied

DIMENSIONS, SYMBOLS, SEED = 1024, 4096, 20_240_229
UNDECIDED = "und"
#: Languages that a model may have: 80 MB of prototypes, sent to every worker. More are refused, never left out.
MOST_LANGS = 20_000


@cache
def _symbols() -> np.ndarray:
    """Symbol by code point: 0 for what isn't a letter; letters keep apart up to the number of symbols."""
    table = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            table[c] = 1 + c % (SYMBOLS - 1)
    return table


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors by symbol for the first, second and third place of a trigram."""
    v = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIMENSIONS), np.int8) * 2 - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, has a letter): the bundle of each text at length 1, zeros where it has no letter."""
    low = [f" {t.lower()} " if t else " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _symbols()[code]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in low])
    lettered = np.bincount(doc[sym > 0], minlength=len(texts)) > 0
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep], doc[keep]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(sym) < 3:
        return out, lettered
    gram = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
    inside = doc[2:] == doc[:-2]
    gram, doc = gram[inside], doc[2:][inside]
    grams, number = np.unique(gram, return_inverse=True)
    if not len(grams):
        return out, lettered
    cell, count = np.unique(doc * len(grams) + number, return_counts=True)
    row, col = np.divmod(cell, len(grams))
    first, second, third = _letters()
    for at in range(0, len(grams), 2048):  # so many trigrams' vectors at a time
        part = grams[at : at + 2048]
        bound = (first[part // SYMBOLS**2] * second[part // SYMBOLS % SYMBOLS] * third[part % SYMBOLS]).astype(np.float32)
        here = (col >= at) & (col < at + 2048)
        r, c, n = row[here], col[here] - at, count[here]
        for top in range(0, len(texts), 512):
            a, b = np.searchsorted(r, (top, top + 512))
            if a < b:
                dense = np.zeros((min(512, len(texts) - top), len(part)), np.float32)
                dense[r[a:b] - top, c[a:b]] = n[a:b]
                out[top : top + 512] += dense @ bound
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1), lettered


def fit(docs: DataFrame, is_training: Column, per_lang: int = 2000) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes): learned from about per_lang texts of each language at most."""
    known = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(rows) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: prototypes are kept by every worker")
    counts = {r["lang"]: r["count"] for r in rows}
    if not counts:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    share = docs.sparkSession.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    chosen = known.select("doc_id", "text", "lang").join(F.broadcast(share), "lang").where(draw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            vectors, _ = bundles(batch.column("text").to_pylist())
            langs = np.array(batch.column("lang").to_pylist(), object)
            names = sorted(set(langs))
            sums = [vectors[langs == x].sum(0, dtype=np.float64).tolist() for x in names]
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))], ["lang", "v"])

    sums = chosen.select("lang", "text").mapInArrow(tidied(run), "lang string, v array<double>")
    rows = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["lang"] for r in rows})
    out, at = np.zeros((len(names), DIMENSIONS), np.float64), {x: i for i, x in enumerate(names)}
    for r in rows:
        out[at[r["lang"]], r["i"]] = r["x"]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return names, (out / np.where(size > 0, size, 1)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score): one row a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names, prototypes = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            vectors, lettered = bundles(batch.column("text").to_pylist())
            if names:
                cosine = vectors @ prototypes.T
                best = cosine.argmax(1)
                pred = [names[b] if ok else UNDECIDED for b, ok in zip(best.tolist(), lettered.tolist())]
                score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            else:
                pred, score = [UNDECIDED] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, lang_pred string, score double")
