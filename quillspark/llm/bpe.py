"""Byte-level BPE encoding and decoding with a public rank file.

Pre-tokenisation is done without a regex. Code points of many texts are mapped to classes in one array; a small
automaton over the classes says where pieces begin. Its transition functions compose associatively, so the state before
each code point is found by a scan: blocks are composed in lockstep, block functions are scanned, and the states inside
all blocks are then read off in lockstep again. The slices between boundaries feed a cached pair merge.

The pieces are those of the pattern that belongs to the rank file: contractions ('s 't 're 've 'm 'll 'd), runs of letters,
of numbers and of other characters, each with one optional space in front, and white space, of which a run's last
character is left for what follows.

Nulls and edges: a null text is empty and has no tokens; texts of any length are encoded whole (long pieces are merged
through a heap); repeated rows give repeated results; doc_id is carried as it is, null included; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import Memo, slices, tidied

RANKS = "byte_bpe_multi_50k.tiktoken"

# Classes of code points, some of them with what follows baked in.
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE, QUOTE1, QUOTE2 = range(8)
# States: nothing open, run of letters / numbers / others, a space that waits, white space, 1 or 2 letters of a contraction to come.
S_NONE, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_C1, S_C2 = range(8)

#: White space of the pattern's \s (Unicode property White_Space), fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers that Unicode 16 has and Python's tables may lack, as first and last code point; fixed values.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece begin here) by class and state before."""
    after, begins = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for s in range(8):
        after[LETTER, s] = S_C1 if s == S_C2 else S_NONE if s == S_C1 else S_LETTER
        begins[LETTER, s] = s not in (S_LETTER, S_SPACE, S_C1, S_C2)
        after[NUMBER, s], begins[NUMBER, s] = S_NUMBER, s not in (S_NUMBER, S_SPACE)
        after[OTHER, s], begins[OTHER, s] = S_OTHER, s not in (S_OTHER, S_SPACE)
        after[SPACE_LAST, s], after[WHITE_LAST, s] = S_SPACE, S_NONE
        after[WHITE, s], begins[WHITE, s] = S_WHITE, s != S_WHITE
        for quote, to in ((QUOTE1, S_C1), (QUOTE2, S_C2)):
            inside = s in (S_OTHER, S_SPACE)
            after[quote, s], begins[quote, s] = S_OTHER if inside else to, not inside
    return after, begins


AFTER, BEGINS = _automaton()


@cache
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[WHITE_SPACE] = WHITE
    return table


def scan_states(classes: np.ndarray, block: int = 64) -> np.ndarray:
    """The state before each position, from S_NONE on, by composing transition functions."""
    n = len(classes)
    rows = -(-n // block)
    padded = np.full(rows * block, WHITE_LAST, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(rows, block).T)
    flat = AFTER.ravel()
    # what each block does to every state
    done = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for c in columns:
        done = flat[(c.astype(np.int16) << 3)[:, None] + done]
    # inclusive scan of the block functions (Hillis-Steele), then the state at the head of each block
    step = 1
    while step < rows:
        joined = done.copy()
        joined[step:] = np.take_along_axis(done[step:], done[:-step].astype(np.intp), axis=1)
        done, step = joined, step * 2
    head = np.full(rows, S_NONE, np.uint8)
    head[1:] = done[:-1, S_NONE]
    states = np.empty((block, rows), np.uint8)
    for i, c in enumerate(columns):
        states[i] = head
        head = flat[(c.astype(np.int16) << 3) + head]
    return states.T.ravel()[:n]


def boundaries(code: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Positions where a piece begins. code: code points of texts laid end to end; heads: where each text begins (none empty)."""
    n = len(code)
    kind = _classes()[code]
    white = kind == WHITE
    ends = np.zeros(n + 1, bool)
    ends[heads] = True
    ends[n] = True
    ends = ends[1:]  # the text ends behind this position
    follows = np.zeros(n, bool)  # something that isn't white space follows in the same text
    follows[:-1] = ~white[1:]
    follows &= ~ends
    kind[white & follows] = WHITE_LAST
    kind[white & follows & (code == 0x20)] = SPACE_LAST
    quote = np.flatnonzero(code == 0x27)
    if len(quote):
        last = np.flatnonzero(ends)
        left = last[np.searchsorted(last, quote)] - quote  # code points of the text behind the quote
        pad = np.concatenate([code, np.zeros(2, code.dtype)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = (left >= 1) & np.isin(a, [ord(x) for x in "stmd"])
        two = (left >= 2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        kind[quote[one]] = QUOTE1
        kind[quote[two]] = QUOTE2
    # a text's first position always begins a piece, so its state doesn't depend on the text before: one inserted reset
    reset = np.insert(kind, heads, WHITE_LAST)
    at = np.arange(n) + np.cumsum(np.bincount(heads, minlength=n)[:n])
    return np.flatnonzero(BEGINS[kind, scan_states(reset)[at]])


@lru_cache(4)
def ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Rank by piece, and piece by rank, from a rank file that every worker has."""
    by_piece = {}
    with open(path, "rb") as f:
        for line in f:
            piece, rank = line.split()
            by_piece[base64.b64decode(piece)] = int(rank)
    by_rank = [b""] * (max(by_piece.values()) + 1)
    for piece, rank in by_piece.items():
        by_rank[rank] = piece
    return by_piece, by_rank


def merge(piece: bytes, by_piece: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of least rank is merged first, of equal ones the leftmost."""
    if piece in by_piece:
        return [by_piece[piece]]
    n = len(piece)
    if n < 64:
        get, never = by_piece.get, 1 << 60
        at = list(range(n + 1))
        pair = [get(piece[i : i + 2], never) for i in range(n - 1)]  # rank of each part joined with the next
        while pair and (best := min(pair)) != never:
            i = pair.index(best)
            del at[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(piece[at[i] : at[i + 2]], never)
            if i:
                pair[i - 1] = get(piece[at[i - 1] : at[i + 1]], never)
        return [by_piece[piece[a:b]] for a, b in zip(at, at[1:])]
    end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := by_piece.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := by_piece.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := by_piece.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(by_piece[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes and decodes texts by one rank file; pieces that were merged before are kept (a bounded cache)."""

    def __init__(self, path: str):
        self.by_piece, self.by_rank = ranks(path)
        self.ids = Memo(lambda piece: struct.pack(f"<{len(i := merge(piece.encode(), self.by_piece))}I", *i), 300_000)
        self.pieces = Memo(self.decode, 300_000)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [x[0] for x in self.encode_with_offsets(texts)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[bytes, list[int], list[int]]]:
        """The same, with the offsets of the text's pieces: the code points at which they begin, and the ids at which they end."""
        out: list[tuple[bytes, list[int], list[int]]] = [(b"", [], [])] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        code = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(full), np.int64)
        np.cumsum([len(texts[i]) for i in full[:-1]], out=heads[1:])
        starts = boundaries(code, heads)
        first = np.searchsorted(starts, heads).tolist() + [len(starts)]
        for k, i in enumerate(full):
            text, own = texts[i], (starts[first[k] : first[k + 1]] - heads[k]).tolist()
            ids = self.ids
            parts = [ids[text[a:b]] for a, b in zip(own, [*own[1:], len(text)])]
            out[i] = (b"".join(parts), own, (np.cumsum(list(map(len, parts))) // 4).tolist())
        return out

    def decode(self, ids: bytes, ends: list[int] | None = None) -> bytes:
        """The bytes of the ids. With the ids at which the pieces end, a piece that was decoded before is taken as a whole."""
        if ends is None:
            return b"".join(map(self.by_rank.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        pieces, a, out = self.pieces, 0, []
        for b in ends:
            out.append(pieces[ids[4 * a : 4 * b]])
            a = b
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded, offsets): the token ids of each whole text, the bytes that they decode to, and the code points at
    which the text's pieces begin."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", 2 << 20):
            ids, starts, stops = zip(*enc.encode_with_offsets([t or "" for t in batch.column("text").to_pylist()]))
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            decoded = pa.array(list(map(enc.decode, ids, stops)), pa.binary())
            offsets = pa.array(starts, pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values), decoded, offsets], ["doc_id", "ids", "decoded", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, ids array<int>, decoded binary, offsets array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces, offsets_sha256): as tokenize, but only digests leave the workers.

    offsets_sha256 is of the code points at which the pieces begin, as little-endian unsigned 32-bit integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", 2 << 20):
            ids, starts, stops = zip(*enc.encode_with_offsets([t or "" for t in batch.column("text").to_pylist()]))
            cols = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(enc.decode(*x)).hexdigest() for x in zip(ids, stops)], pa.string()),
                pa.array([len(x) for x in starts], pa.int64()),
                pa.array([hashlib.sha256(np.array(x, "<u4")).hexdigest() for x in starts], pa.string()),
            ]
            yield pa.record_batch([batch.column("doc_id"), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces", "offsets_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long, offsets_sha256 string")
