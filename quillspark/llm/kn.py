"""Interpolated modified Kneser-Ney models over characters, as sorted arrays of packed n-grams.

A symbol takes BITS bits, so an n-gram of up to ORDER symbols is one 64-bit integer: its context is the integer without the
last symbol, its backoff the integer without the first. Words are modelled one by one between boundary symbols. Training
counts come from Spark; scoring is vectorised over the distinct words of a batch, and a word's result is kept (a bounded
cache), so a corpus costs little more than a dictionary lookup a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS, ORDER = 10, 6
_MASK = (1 << BITS) - 1
#: Symbol of a word's boundary; other code points take 1 and up, wrapped into the number of symbols.
EDGE = 0


def pack(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, lengths): for each word the packed n-grams that end in its characters and in the closing boundary."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = "\0"
    joined = (edge * (order - 1)).join(["", *words]) + edge * (order - 1)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sym = np.where(code == 0, np.uint64(EDGE), 1 + (code - 1) % np.uint64(_MASK))
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths - 1 + order - 1)[:-1]]) + order - 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    gram = np.zeros(len(at), np.uint64)
    for back in range(order - 1, -1, -1):
        gram = gram << np.uint64(BITS) | sym[at - back]
    return gram, lengths


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def discounts(counts: np.ndarray) -> np.ndarray:
    """D by count (0, 1, 2, 3 and more) from the counts of counts, by the usual estimate; guarded where some are missing."""
    n1, n2, n3, n4 = (int((counts == i).sum()) for i in (1, 2, 3, 4))
    return discounts_of(n1, n2, n3, n4)


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return np.array([0, np.clip(d1, 0.05, 0.95), np.clip(d2, 0.05, 1.95), np.clip(d3, 0.05, 2.95)])


@dataclass
class Level:
    """One order of a model: n-grams with their discounted share, contexts with the weight of the lower order."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> Level:
        d = discounts(counts)
        kind = np.minimum(counts, 3).astype(np.int64)
        context = grams >> np.uint64(BITS)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(grams) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0)
        size = np.diff(np.concatenate([first, [len(grams)]]))
        share = (counts - d[kind]) / np.repeat(total, size)
        backoff = np.add.reduceat(d[kind], first) / total if len(first) else np.zeros(0)
        return cls(grams, share.astype(np.float32), context[first], backoff.astype(np.float32))

    def apply(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolate the lower order's probabilities with this order."""
        if not len(self.grams):
            return lower
        at = np.minimum(np.searchsorted(self.contexts, grams >> np.uint64(BITS)), len(self.contexts) - 1)
        known = self.contexts[at] == grams >> np.uint64(BITS)
        p = np.where(known, self.backoff[at] * lower, lower)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return p + np.where(self.grams[at] == grams, self.share[at], 0)


def continuations(grams: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower n-grams, in how many contexts of one more symbol each occurs) from the distinct n-grams of an order."""
    mask = np.uint64((1 << BITS * (order - 1)) - 1)
    return np.unique(grams & mask, return_counts=True)


class CharModel:
    """Kneser-Ney over characters. top: counted n-grams of the highest order; shared: n-grams that the lower orders are
    continued from, by default the same."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, shared: np.ndarray | None = None, order: int = ORDER):
        self.order = order
        top, counts = _sums(top, counts)
        self.levels = [Level.of(top, counts)]
        grams = top if shared is None else np.unique(shared)
        for k in range(order, 1, -1):
            grams, seen = continuations(grams, k)
            self.levels.append(Level.of(grams, seen))
        self.levels.reverse()

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), 1 / (_MASK + 1))
        for k, level in enumerate(self.levels, 1):
            p = level.apply(grams & np.uint64((1 << BITS * k) - 1), p)
        return p

    def log_words(self, words: list[str]) -> np.ndarray:
        """Natural-log probability of each word with its closing boundary."""
        return log_by_word(self.probabilities, words, self.order)


def log_by_word(probabilities, words: list[str], order: int = ORDER) -> np.ndarray:
    grams, lengths = pack(words, order)
    if not len(words):
        return np.zeros(0)
    distinct, back = np.unique(grams, return_inverse=True)
    logs = np.log(probabilities(distinct))[back]
    return np.add.reduceat(logs, np.concatenate([[0], np.cumsum(lengths)[:-1]]))


class PairModel:
    """Two classes' models: their own counts at the highest order, shared lower orders."""

    def __init__(self, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], order: int = ORDER):
        self.order = order
        self.tops = [Level.of(*_sums(*x)) for x in (one, other)]
        self.lower = CharModel(np.concatenate([one[0], other[0]]), np.ones(len(one[0]) + len(other[0]), np.int64), order=order).levels[:-1]

    def log_ratio(self, words: list[str]) -> np.ndarray:
        """ln p(word | other) - ln p(word | one)."""
        if not words:
            return np.zeros(0)
        grams, lengths = pack(words, self.order)
        distinct, back = np.unique(grams, return_inverse=True)
        p = np.full(len(distinct), 1 / (_MASK + 1))
        for k, level in enumerate(self.lower, 1):
            p = level.apply(distinct & np.uint64((1 << BITS * k) - 1), p)
        one, other = (top.apply(distinct, p) for top in self.tops)
        return np.add.reduceat((np.log(other) - np.log(one))[back], np.concatenate([[0], np.cumsum(lengths)[:-1]]))


class WordCache:
    """Values of words, computed for a batch's unknown words at once; emptied when it holds `most` of them."""

    def __init__(self, values, most: int = 400_000):
        self.values, self.most, self.known = values, most, {}

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The values of each text's words."""
        known = self.known
        new = list({w for ws in texts for w in ws if w not in known})
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = list({w for ws in texts for w in ws})
            known.update(zip(new, self.values([w.decode("utf-8", "replace") for w in new]).tolist()))
        get = known.__getitem__
        return [np.fromiter(map(get, ws), np.float64, len(ws)) for ws in texts]


def gram_counts(texts, groups: list[str], words, order: int = ORDER):
    """(group columns, gram, n): counts of packed n-grams in a frame of (group columns, text). words: text to words."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from quillspark.llm.common import raw_texts, slices, tidied

    def run(batches):
        for batch in slices(batches, "text"):
            keys = list(zip(*(batch.column(g).to_pylist() for g in groups))) if groups else [()] * batch.num_rows
            split = [words(t) for t in raw_texts(batch.column("text"))]
            for key in sorted(set(keys)):
                counted: dict[bytes, int] = {}
                for k, ws in zip(keys, split):
                    if k == key:
                        for w in ws:
                            counted[w] = counted.get(w, 0) + 1
                if counted:
                    gram, length = pack([w.decode("utf-8", "replace") for w in counted], order)
                    gram, n = _sums(gram, np.repeat(np.array(list(counted.values()), np.int64), length))
                    cols = [pa.array([v] * len(gram), pa.int32()) for v in key]
                    yield pa.record_batch([*cols, pa.array(gram.view(np.int64)), pa.array(n)], [*groups, "gram", "n"])

    schema = ", ".join([*(f"{g} int" for g in groups), "gram long, n long"])
    return texts.mapInArrow(tidied(run), schema).groupBy(*groups, "gram").agg(F.sum("n").alias("n"))
