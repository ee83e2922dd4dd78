"""Toxicity from class-conditional Kneser-Ney models.

Toxic and ordinary labelled texts each give counts of character n-grams within words at the highest order; the lower orders
are shared by both, so a rare or inflected expression is smoothed by what both classes have seen. A toxic text is taken as
words of which a share SHARE comes from the toxic model and the others, as all of an ordinary text, from the ordinary one.
The deciding figure is the difference of the two log-likelihoods of the whole text, divided by its number of words to the
power NORM; a word's own difference counts as 50 at most, so that its exponential stays finite; nothing else enters. A logistic curve over its logarithm, fitted on texts that the models which score them have
not seen (FOLDS folds), turns it into a probability, laid so that THRESHOLD is where the share of missed toxic texts of these and
ALARM_COST times the share of ordinary ones that reach it are least in sum, in the middle of a gap between the two.

Models are fitted on a hash sample of at most about `max_rows` labelled rows and `max_chars` characters of each class (a
documented bound), chosen by doc_id only; the final models use all folds.

Nulls and edges: a null or empty text has no evidence and gets the curve's value for none; texts of any length are read
whole; a document with several labels is toxic if one says so, labels other than 0 and 1 are ignored; repeated rows give
repeated results; doc_id is carried as it is; without labels of both classes the score is 0, or 1 if all labels are toxic;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, raw_texts, slices, tidied
from quillspark.llm.kn import PairModel, WordCache, gram_counts

ORDER, FOLDS = 5, 4
#: Share of toxic words in a toxic text, power of the length, least figure that is told from none, cost of a false alarm.
#: Compared on the training rows of sf0.1 alone (329 toxic, 2,661 ordinary), in three parts that are scored by models and bars
#: fitted on the other two. Recall and false alarms: 0.918 and 0.0124 as set; cost 1: 0.927 and 0.0210; cost 10: 0.854 and
#: 0.0079; power 1: 0.915 and 0.0199; share 0.02: 0.903 and 0.0068. Costs 1 and 3 have the same sum of both errors, and 3 the
#: fewer false alarms. The plain difference over the number of words (share 1, power 1): 0.584 and 0.0214, as a few toxic words
#: are lost among the others; hence the mixture.
SHARE, NORM, FLOOR, ALARM_COST = 0.002, 0.75, 0.001, 3
THRESHOLD = 0.3
#: Bytes as words are split: A-Z lowered, other ASCII but letters is white space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def letters(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def evidence(ratios: list[np.ndarray]) -> np.ndarray:
    """For each text, from the ln p(word | toxic) - ln p(word | ordinary) of its words, the logarithm of its length-normalised
    log-likelihood difference; FLOOR stands for none."""
    total = np.array([np.log1p(SHARE * np.expm1(np.minimum(r, 50))).sum() if len(r) else 0.0 for r in ratios])
    return np.log(np.maximum(total, 0) / np.array([max(1, len(r)) for r in ratios]) ** NORM + FLOOR)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, the constant last (not penalised)."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.array([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """A fitted scorer; pair is None if only one class is known, with its constant score."""

    def __init__(self, pair: PairModel | None, curve: tuple[float, float], constant: float):
        self.pair, self.curve, self.constant = pair, curve, constant
        self.cache: WordCache | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": None}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.pair is None:
            return np.full(len(texts), self.constant)
        if self.cache is None:
            self.cache = WordCache(self.pair.log_ratio)
        slope, base = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * evidence(self.cache.of([letters(t) for t in texts])) + base, -35, 35)))


def _labelled(docs: DataFrame, labels: DataFrame, is_training: Column | None) -> DataFrame:
    own = labels.where("toxic in (0, 1) and doc_id is not null")
    if is_training is not None:
        own = own.where(is_training)
    return own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, is_training: Column | None = None, max_rows: int = 4000, max_chars: int = 16_000_000) -> Model:
    """Learn from labelled documents; is_training is a condition on the labels' doc_id."""
    own = _labelled(docs, labels, is_training)
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(own, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    found = {r["toxic"]: r for r in sizes.collect()}
    if len(found) < 2:
        return Model(None, (0.0, 0.0), float(list(found) == [1]))
    share = {c: min(1.0, max_rows / r["n"], max_chars / max(1, r["chars"])) for c, r in found.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(2_000_000))
    limit = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * 2_000_000
    chosen = own.where(draw < limit).select("doc_id", "toxic", (draw % FOLDS).cast("int").alias("fold"))
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "fold", F.coalesce("text", F.lit("")).alias("text")), "toxicity")
    grams = gram_counts(sample, ["toxic", "fold"], letters, ORDER).toArrow()
    toxic, fold, gram, n = (grams.column(c).to_numpy() for c in ("toxic", "fold", "gram", "n"))
    gram = gram.view(np.uint64)

    def pair(of_fold: np.ndarray) -> PairModel:
        return PairModel(*((gram[m], n[m]) for m in (of_fold & (toxic == c) for c in (0, 1))), order=ORDER)

    folds = sample.sparkSession.sparkContext.broadcast([pair(fold != f) for f in range(FOLDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = [WordCache(p.log_ratio) for p in folds.value]
        for batch in slices(batches, "text"):
            texts, own_fold = [letters(t) for t in raw_texts(batch.column("text"))], batch.column("fold").to_numpy()
            x = np.zeros(len(texts))
            for f in range(FOLDS):
                at = np.flatnonzero(own_fold == f)
                x[at] = evidence(caches[f].of([texts[i] for i in at]))
            yield pa.record_batch([batch.column("toxic"), pa.array(x)], ["toxic", "x"])

    seen = sample.mapInArrow(tidied(run), "toxic int, x double").toArrow()
    folds.destroy()
    return Model(pair(fold >= 0), curve_of(seen.column("x").to_numpy(), seen.column("toxic").to_numpy(), share), 0.0)


def curve_of(x: np.ndarray, toxic: np.ndarray, share: dict[int, float]) -> tuple[float, float]:
    """(slope, constant) of the logistic curve; share: of each class's rows that were drawn."""
    order = np.lexsort((x, toxic))  # sums in one order, however the rows came
    x, y = x[order], toxic[order].astype(float)
    if not len(x):
        return 1.0, 0.0
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    slope = max(0.1, float(logistic(x[:, None], y, weight / weight.mean())[0]))
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * bar_of(x[y == 0], x[y == 1]))


def bar_of(ordinary: np.ndarray, toxic: np.ndarray) -> float:
    """The figure from which a text counts as toxic: of the places between known figures the middle one of the least cost."""
    known = np.unique(np.concatenate([ordinary, toxic]))
    places = np.append((known[1:] + known[:-1]) / 2, known[-1] + 1)
    alarms = 1 - np.searchsorted(np.sort(ordinary), places) / max(1, len(ordinary))
    misses = np.searchsorted(np.sort(toxic), places) / max(1, len(toxic))
    cost = ALARM_COST * alarms + misses
    least = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(places[least[len(least) // 2]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability that a document is toxic."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = shared.value.score(raw_texts(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(shared.value.score(raw_texts(batch.column("text"))) < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
