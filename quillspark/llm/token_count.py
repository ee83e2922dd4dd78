"""Token counts by a linear longest-match automaton.

A word's pieces are found greedily: the longest vocabulary piece that begins the rest, again and again. The automaton is a
trie of the vocabulary with failure links: where no child fits, the link leads to the node for what is left after the pieces
that greedy matching would cut off, and the number of those popped pieces is stored with the link. One walk over a word's
bytes gives its number of pieces in linear time; no piece is built. Counts of frequent words are kept (a bounded cache).

Words are split at ASCII white space and read with one space in front, as the byte-level vocabularies store word starts. A
word that can't be cut into pieces counts as one unknown token; the default vocabulary has every byte, so none occurs.

Nulls and edges: a null or blank text has no tokens; words and texts of any length are read whole; repeated rows give
repeated results; doc_id is carried as it is, null included; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.bpe import ranks
from quillspark.llm.common import Memo, raw_texts, slices, tidied


class LongestMatch:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, vocabulary: Iterable[bytes]):
        child: dict[int, int] = {}
        is_piece = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                at = child.setdefault(at << 8 | c, len(is_piece))
                if at == len(is_piece):
                    is_piece.append(False)
            is_piece[at] = at > 0
        n = len(is_piece)
        link, popped = [-1] * n, [0] * n  # -1: greedy matching fails
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, to in child.items():
            below[key >> 8].append((key & 255, to))
        level = [0]
        while level:
            following = []
            for u in level:
                for c, v in below[u]:
                    following.append(v)
                    if is_piece[v]:
                        link[v], popped[v] = 0, 1
                        continue
                    z, count = link[u], popped[u]
                    while z >= 0 and (z << 8 | c) not in child:
                        count += popped[z]
                        z = link[z]
                    if z >= 0:
                        link[v], popped[v] = child[z << 8 | c], count
            level = following
        self.child, self.link, self.popped = child, link, popped

    def count(self, word: bytes) -> int:
        """Pieces of the word by greedy longest match; 1 if it can't be cut into pieces."""
        child, link, popped = self.child, self.link, self.popped
        at = total = 0
        for c in word:
            while (to := child.get(at << 8 | c)) is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = to
        while at:
            total += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return total


@lru_cache(2)
def _counter(path: str) -> Memo:
    automaton = LongestMatch(ranks(path)[0])
    return Memo(lambda word: automaton.count(b" " + word))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens): one row a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches, "text"):
            words = [t.split() for t in raw_texts(batch.column("text"))]
            n_words = np.array([len(w) for w in words], np.int64)
            n_tokens = np.array([sum(map(counter.__getitem__, w)) for w in words], np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_words long, n_tokens long")
