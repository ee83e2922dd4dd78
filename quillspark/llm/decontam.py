"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and marks, A-Z lowered; each code point of a script that is written without spaces
(UNSPACED) is a token of its own. White space, punctuation, symbols and controls of Unicode separate. A seed is WINDOW - 1 tokens long, cut into four
blocks; each of six fixed masks ignores two of the blocks and hashes the tokens of the others. Whatever two tokens of a
seed are substituted, some mask ignores both. Test hashes and training hashes are joined, and around each hit the text and
the benchmark item are laid side by side: the document is contaminated by the item if some WINDOW consecutive tokens of
the item stand in it with at most 20 % of them substituted. Items shorter than WINDOW count as one window of their own
length, with seeds of that length; an item of fewer than SHORTEST tokens inside a longer text can't be told from chance, so it
contaminates the documents that have its tokens and no others.

The benchmark is read in blocks of at most `block_tokens` tokens (a longer item stands alone), PASS_BLOCKS of them a pass over
the corpus, so what is broadcast, and joined on the map side without a shuffle of the corpus, is bounded; a larger benchmark
takes more passes.

Nulls and edges: a null or empty text or item has no tokens and matches nothing; an item without an id contaminates but is
not listed; texts of any length are read whole; repeated items are all listed, repeated rows give repeated results; doc_id
is carried as it is; an empty benchmark contaminates nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quillspark.llm.common import Memo, materialize, raw_texts, slices, tidied

WINDOW, SHORTEST, SUBSTITUTED = 13, 5, 0.2
#: Pairs of a seed in a text and one in an item that are looked at together.
PIECE_HITS = 1 << 18
#: Blocks of the benchmark that are searched in one pass over the corpus.
PASS_BLOCKS = 4
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_BITMAP_BITS = 24
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.default_rng(12).integers(0, 1 << 63, 1024, np.uint64)


#: Thai, Lao, Myanmar, Khmer, Tai, Han, Kana and Bopomofo, as first and last code point; fixed values.
UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029),
    (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
]


def _class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """(separators beyond ASCII, code points that are tokens of their own)."""
    apart = [c for c in range(0x80, sys.maxunicode + 1) if (k := unicodedata.category(chr(c)))[0] in "PSZ" or k == "Cc" or c in (0x200B, 0x2060, 0xFEFF)]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(apart), lambda x: x[1] - x[0])]
    return re.compile(_class([(x[0], x[-1]) for x in runs]) + "+"), re.compile(_class(UNSPACED))


def tokens(text: bytes) -> list[bytes]:
    if not text.isascii():
        apart, alone = _patterns()
        text = alone.sub(r" \g<0> ", apart.sub(" ", text.decode(errors="surrogateescape"))).encode(errors="surrogateescape")
    return text.translate(_FOLD).split()


def seed_hashes(token_hashes: np.ndarray, span: int) -> Iterator[np.ndarray]:
    """For each of the six masks the hash at every position where a seed of that span fits."""
    n = len(token_hashes) - span + 1
    if n <= 0:
        return
    edges = [round(span * i / 4) for i in range(5)]
    blocks = []
    for a, b in zip(edges, edges[1:]):
        total = np.zeros(n, np.uint64)
        for i in range(a, b):
            total += token_hashes[i : i + n] * _FACTORS[i]
        total ^= total >> np.uint64(29)
        blocks.append(total * _FACTORS[-1])
    for m, (a, b) in enumerate(combinations(range(4), 2)):
        yield blocks[a] * _FACTORS[40 + m] + blocks[b] * _FACTORS[50 + m] + _SALTS[span * 6 + m]


class Block:
    """Seeds and tokens of some benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        same: dict[tuple[bytes, ...], list[int | None]] = defaultdict(list)
        self.whole: dict[tuple[bytes, ...], list[int | None]] = defaultdict(list)  # short items, matched as whole texts
        for item_id, text in items:
            words = tuple(tokens(text))
            if words:
                (same if len(words) >= SHORTEST else self.whole)[words].append(item_id)
        self.ids = [sorted(i for i in ids if i is not None) for ids in same.values()]
        self.words = [np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64) for ws in same]
        self.spans = sorted({min(WINDOW - 1, len(w)) for w in self.words})
        parts = []
        for i, w in enumerate(self.words):
            for h in seed_hashes(w, min(WINDOW - 1, len(w))):
                parts.append((h, np.full(len(h), i, np.int32), np.arange(len(h), dtype=np.int32)))
        self.hash, self.item, self.offset = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.offset = self.hash[order], self.item[order], self.offset[order]
        self.bitmap = np.zeros(1 << _BITMAP_BITS >> 3, np.uint8)
        at = self.hash >> np.uint64(64 - _BITMAP_BITS)
        np.bitwise_or.at(self.bitmap, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def seeds(self, token_hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each span and mask the positions where the tokens share a seed with items, and the range of these seeds."""
        for span in self.spans:
            for h in seed_hashes(token_hashes, span):
                at = h >> np.uint64(64 - _BITMAP_BITS)
                maybe = np.flatnonzero(self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                left, right = np.searchsorted(self.hash, h[maybe], "left"), np.searchsorted(self.hash, h[maybe], "right")
                some = right > left
                if some.any():
                    yield maybe[some], left[some], right[some]

    def unfound(self, found: list[set[int]], text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of some seeds' positions those in a text that isn't known yet to hold all items of the seed."""
        open_ = np.ones(len(left), bool)
        known = np.array([bool(f) for f in found])[text]
        if known.any():
            at = np.flatnonzero(known)
            _, first, inverse = np.unique(text[at] * (len(self.hash) + 1) + left[at], return_index=True, return_inverse=True)
            left_over = [not found[text[i]].issuperset(self.item[left[i] : right[i]].tolist()) for i in at[first].tolist()]
            open_[at] = np.array(left_over)[inverse]
        return open_

    def places(self, position: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place of the item's first token) of seeds that are shared; without repeats."""
        count = right - left
        seed = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pairs = np.unique((self.item[seed].astype(np.int64) << 40) + np.repeat(position, count) - self.offset[seed] + (1 << 39))
        return pairs >> 40, (pairs & ((1 << 40) - 1)) - (1 << 39)

    def overlaps(self, item: int, text: np.ndarray, place: int) -> bool:
        """Does a window of the item stand in the text, the item's first token at this place, with few substitutions?"""
        words = self.words[item]
        window = min(WINDOW, len(words))
        a, b = max(0, -place), min(len(words), len(text) - place)
        if b - a < window:
            return False
        same = np.concatenate([[0], np.cumsum(words[a:b] == text[place + a : place + b])])
        return int((same[window:] - same[:-window]).max()) >= window - int(SUBSTITUTED * window)

    def leaks(self, token_hashes: np.ndarray, heads: np.ndarray) -> list[set[int]]:
        """For each text (laid end to end, beginning at heads) the numbers of the items that it holds a window of."""
        found: list[set[int]] = [set() for _ in heads]
        ends = np.append(heads[1:], len(token_hashes))
        for position, left, right in self.seeds(token_hashes):
            text = np.searchsorted(heads, position, "right") - 1
            changed = True
            while len(position):
                if changed:
                    open_ = self.unfound(found, text, left, right)
                    position, left, right, text = position[open_], left[open_], right[open_], text[open_]
                    if not len(position):
                        break
                n = max(1, int(np.searchsorted(np.cumsum(right - left), PIECE_HITS, "right")))
                changed = self._walk(*self.places(position[:n], left[:n], right[:n]), token_hashes, heads, ends, found)
                position, left, right, text = position[n:], left[n:], right[n:], text[n:]
        return found

    def _walk(self, items: np.ndarray, places: np.ndarray, token_hashes: np.ndarray, heads: np.ndarray, ends: np.ndarray, found: list[set[int]]) -> bool:
        """Look at the items at these places; whether any was found in a text."""
        any_ = False
        # a seed may begin in one text and end in the next; the window is looked for in every text that the item would touch
        at = np.maximum(0, np.searchsorted(heads, places, "right") - 1)
        for i, place, first in zip(items.tolist(), places.tolist(), at.tolist()):
            while first < len(heads) and heads[first] < place + len(self.words[i]):
                if i not in found[first] and self.overlaps(i, token_hashes[heads[first] : ends[first]], place - int(heads[first])):
                    found[first].add(i)
                    any_ = True
                first += 1
        return any_


def blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[Block]:
    """Blocks of bounded size, read from the table bit by bit."""
    part, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if row["text"]:
            size = len(tokens(row["text"].encode()))
            if part and n + size > block_tokens:
                yield Block(part)
                part, n = [], 0
            part.append((row["item_id"], row["text"].encode()))
            n += size
    if part:
        yield Block(part)


def passes(benchmark: DataFrame, block_tokens: int) -> Iterator[list[Block]]:
    """The blocks that are searched together."""
    found = blocks(benchmark, block_tokens)
    while part := list(islice(found, PASS_BLOCKS)):
        yield part


def _scan(parts: list[Block], texts: list[bytes], memo: Memo) -> list[tuple[bool, list[int]]]:
    """(contaminated, item ids) of each text."""
    words = [tokens(t) for t in texts]
    heads = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1].astype(np.int64)
    hashes = np.fromiter((memo[w] for ws in words for w in ws), np.uint64, sum(map(len, words)))
    leaked, ids = [False] * len(texts), [set() for _ in texts]
    for block in parts:
        for k, (ws, found) in enumerate(zip(words, block.leaks(hashes, heads))):
            listed = [block.ids[n] for n in found]
            if len(ws) < SHORTEST and (short := block.whole.get(tuple(ws))):
                listed.append([i for i in short if i is not None])
            leaked[k] |= bool(listed)
            ids[k].update(*listed)
    return [(a, sorted(b)) for a, b in zip(leaked, ids)]


def find(docs: DataFrame, benchmark: DataFrame, block_tokens: int = 500_000) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids): one row a document, item_ids in order."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    marked, shared = None, None
    for part in passes(benchmark, block_tokens):
        if marked is None:
            before = docs.select("doc_id", "text")
        else:
            before = materialize(marked, "decontam")
            shared.destroy()
        shared = spark.sparkContext.broadcast(part)
        marked = _pass(before, shared, kind)
    if marked is None:
        return docs.selectExpr("doc_id", "false AS contaminated", "0L AS n_items", "CAST(array() AS array<bigint>) AS item_ids")
    return marked.selectExpr("doc_id", "contaminated", "CAST(size(item_ids) AS bigint) AS n_items", "item_ids")


def _pass(docs: DataFrame, shared, kind: str) -> DataFrame:
    """Marks from some blocks, joined with those of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh64_intdigest)
        for batch in slices(batches, "text", 1 << 20):
            got = _scan(shared.value, raw_texts(batch.column("text")), memo)
            if "item_ids" in batch.schema.names:
                before = zip(batch.column("contaminated").to_pylist(), batch.column("item_ids").to_pylist())
                got = [(a or c, sorted({*b, *d})) for (a, b), (c, d) in zip(got, before)]
            marks = [pa.array([x for x, _ in got], pa.bool_()), pa.array([x for _, x in got], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text"), *marks], ["doc_id", "text", "contaminated", "item_ids"])

    return docs.mapInArrow(tidied(run), f"doc_id {kind}, text string, contaminated boolean, item_ids array<bigint>")


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_tokens: int = 500_000) -> DataFrame:
    """The documents, with all their columns, that hold no passage of the benchmark."""
    last = None
    for part in passes(benchmark, block_tokens):
        if last is not None:
            docs = materialize(docs, "decontam")
            last.destroy()
        shared = last = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memo = Memo(xxhash.xxh64_intdigest)
            for batch in slices(batches, "text", 1 << 20):
                leaked = [x for x, _ in _scan(shared.value, raw_texts(batch.column("text")), memo)]
                yield batch.filter(pa.array([not x for x in leaked], pa.bool_()))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
