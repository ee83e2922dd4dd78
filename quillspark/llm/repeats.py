"""Exact repeated passages: bytes covered by a window of so many bytes that also starts anywhere else.

*Candidates.* A window's anchor is the place in it whose ANCHOR bytes hash lowest (the leftmost of equals), so equal windows
have equal anchors at equal offsets. Neighbouring windows with one anchor form a place: the stretch of text they span. Places
are told by their anchor (key) and by a 128-bit digest of their stretch. A key that occurs once holds no repeat; equal stretches
are repeats of one another. Only keys with different stretches need their bytes, of one place a stretch.

*Suffixes.* The stretches of a key go to one task, which finds their repeated windows by interval expansion on a
Burrows-Wheeler transform (`bwt`), some keys at a time.

*Hot keys.* A key with more than MOST_STRETCHES different stretches is split: windows that start before the middle of those
possible share the bytes from there to the end of the anchor, the others those from the anchor to the middle one's end. So each
stretch becomes two with longer anchors, which part into keys of their own; equal ones are counted, not compared. A window
has less than WINDOW - ANCHOR possible starts, so halving ends after at most 8 rounds, when an anchor is the whole window.

*Spark.* Keys are counted on narrow rows; texts are shuffled to fetch stretches and to cut them, never by a key. Each step is
written to the shared folder. No task holds more than one key's stretches, of which there are at most MOST_STRETCHES.

Nulls and edges: a null text is empty; texts shorter than the window keep all; repeated rows are repeats of one another, rows
with a null or repeated id each have a result; an empty table gives an empty result; extra columns are ignored; a text of
any length is worked through in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bwt import repeated
from quillspark.llm.common import discard, free_shuffles, materialize, raw_texts, slices, tidied

WINDOW, ANCHOR = 200, 64
#: Bytes of text whose windows are worked on at once, and of stretches in one transform.
PIECE, SHARD_BYTES = 1 << 18, 1 << 18
MOST_STRETCHES = 1024
_POSITION = 22  # bits of a place in a piece

_PLACE = "at long, n int, cl int, cr int, key long, c1 long, c2 long"


def _digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each stretch of `length` bytes (a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    while size < length:
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9) + h[size:] if len(h) > size else h[:0]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        size *= 2
    return h


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def places_of(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor's begin in the stretch, key, digest as two numbers) of all places."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)  # each byte's text
    fits = own[window - 1 :] == own[: max(0, len(own) - window + 1)]
    raw, found = np.frombuffer(data, np.uint8), []
    low = np.uint64((1 << _POSITION) - 1)
    for at in range(0, max(0, len(data) - window + 1), PIECE):
        h = gram_hashes(raw[at : at + PIECE + window - 1], anchor)
        spot = (sliding_min(h & ~low | np.arange(len(h), dtype=np.uint64), window - anchor + 1) & low).view(np.int64)
        start = np.flatnonzero(fits[at : at + PIECE])
        spot, text = spot[start], own[start + at]
        if not len(start):
            continue
        cut = np.flatnonzero((spot[1:] != spot[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        first, n = start[np.concatenate([[0], cut])], np.diff(np.concatenate([[0], cut, [len(start)]]))
        spot, text = spot[np.concatenate([[0], cut])], text[np.concatenate([[0], cut])]
        lo = (first + at).tolist()
        digests = b"".join([_digest(data[a : a + k + window - 1]) for a, k in zip(lo, n.tolist())])
        found.append((text, first + at - begins[text], n, spot - first, h[spot].view(np.int64), np.frombuffer(digests, np.int64).reshape(-1, 2)))
    if not found:
        return (*(np.empty(0, np.int64) for _ in range(5)), np.empty((0, 2), np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _columns(at, n, cl, cr, key, digest) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in ((at, pa.int64()), (n, pa.int32()), (cl, pa.int32()), (cr, pa.int32()), (key, pa.int64()), (digest[:, 0], pa.int64()), (digest[:, 1], pa.int64()))]


_NAMES = ["at", "n", "cl", "cr", "key", "c1", "c2"]


def _places(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            text, at, n, cl, key, digest = places_of(raw_texts(batch.column("text")), window, anchor)
            yield pa.record_batch([batch.column("row").take(pa.array(text)), *_columns(at, n, cl, cl + anchor, key, digest)], ["row", *_NAMES])

    return run


def _cut_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the stretches that a text must show."""
        for batch in slices(batches, "text", PIECE):
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            texts = raw_texts(batch.column("text"))
            names = ["at", "n", "cl", "cr", "key", "c1", "c2", "copies"]
            cols = [flat.field(c) for c in names]
            cut = [texts[i][a : a + k + window - 1] for i, a, k in zip(own.tolist(), cols[0].to_pylist(), cols[1].to_pylist())]
            yield pa.record_batch([*cols[1:], pa.array(cut, pa.binary())], [*names[1:], "text"])

    return run


def _expand(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches sorted by key: the runs of their windows that start elsewhere too."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "copies", "text"))):
                if size > SHARD_BYTES and row[0] != held[-1][0]:
                    yield _runs(held, window)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield _runs(held, window)

    return run


def _runs(held: list[tuple], window: int) -> pa.RecordBatch:
    out = []
    for (key, c1, c2, copies, text), shared in zip(held, repeated([r[4] for r in held], window)):
        n = len(text) - window + 1
        if copies > 1:
            out.append((key, c1, c2, 0, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], shared[:n].astype(np.int8), [0]])))
        out += [(key, c1, c2, a, b) for a, b in edge.reshape(-1, 2).tolist()]
    cols = list(zip(*out)) or [[]] * 5
    return pa.record_batch([pa.array(c, pa.int64() if i < 3 else pa.int32()) for i, c in enumerate(cols)], ["key", "c1", "c2", "start", "stop"])


def halves(text: bytes, n: int, cl: int, cr: int, window: int) -> list[tuple[int, int, int, int, int]]:
    """(side, first window, windows, anchor's begin and end in the new stretch): the windows of a stretch in two classes."""
    middle = (cr - window + cl + 1) // 2
    out = []
    if (k := min(n, middle)) > 0:
        out.append((0, 0, k, middle - 1, cr))
    if (first := max(0, middle)) < n:
        out.append((1, first, n - first, cl - first, middle + window - first))
    return out


def _split(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, c1, c2, n, cl, cr, text in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "n", "cl", "cr", "text"))):
                for side, first, k, left, right in halves(text, n, cl, cr, window):
                    new = text[first : first + k + window - 1]
                    below = int.from_bytes(_digest(b"%d %d " % (side, key) + new[left:right], 8), "little", signed=True)
                    out.append((key, c1, c2, first, k, left, right, below, *np.frombuffer(_digest(new), np.int64).tolist(), new))
            cols = list(zip(*out)) or [[]] * 11
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64()] * 3 + [pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], ["o0", "o1", "o2", *_NAMES, "text"])

    return run


def _runs_of(places: DataFrame, owner: list[str], window: int, fetch, most: int) -> DataFrame:
    """(owner, start, stop): runs of windows that also start elsewhere, by number of the window in the owner."""
    apart = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    keys = materialize(places.groupBy("key").agg(F.count(F.lit(1)).alias("had"), apart.alias("mixed")).where("had > 1").select("key", "mixed"), "keys")
    shared = materialize(places.join(keys, "key"), "places")
    discard(places, keys)
    free_shuffles(places.sparkSession)
    whole = shared.where("NOT mixed").select(*owner, F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("stop"))
    mixed = shared.where("mixed")
    carried = [c for c in shared.columns if c not in ("key", "c1", "c2", "mixed")]
    one = mixed.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in carried))
    stretches = materialize(fetch(one), "stretches")
    free_shuffles(places.sparkSession)
    hot = materialize(stretches.groupBy("key").agg(F.count(F.lit(1)).alias("had")).where(F.col("had") > most).select("key"), "hot")
    split = bool(hot.head(1))
    calm = stretches.join(hot, "key", "left_anti") if split else stretches
    dealt = calm.select("key", "c1", "c2", "copies", "text").repartition("key").sortWithinPartitions("key", "c1", "c2")
    found = [dealt.mapInArrow(tidied(_expand(window)), "key long, c1 long, c2 long, start int, stop int")]
    if split:
        parts = stretches.join(hot, "key", "left_semi")
        found.append(parts.where("copies > 1").select("key", "c1", "c2", F.lit(0).alias("start"), F.col("n").alias("stop")))
        below = parts.select("key", "c1", "c2", "n", "cl", "cr", "text").mapInArrow(_split(window), f"o0 long, o1 long, o2 long, {_PLACE}, text binary")
        lower = _runs_of(materialize(below, "halves"), ["o0", "o1", "o2"], window, lambda rows: rows, most)
        found.append(lower.select(F.col("o0").alias("key"), F.col("o1").alias("c1"), F.col("o2").alias("c2"), F.col("start").cast("int"), F.col("stop").cast("int")))
    runs = materialize(reduce(DataFrame.unionByName, found), "runs")
    discard(stretches)
    each = mixed.join(runs, ["key", "c1", "c2"]).select(*owner, (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"))
    return whole.unionByName(each)


def _numbered(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text.alias("text")), "texts")


def repeated_runs(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST_STRETCHES) -> DataFrame:
    """(row, start, stop) of texts (row, text as binary): runs of windows that also start anywhere else."""
    if anchor & (anchor - 1) or not 0 < anchor <= window:
        raise ValueError("an anchor is a power of two of bytes, at most a window")
    places = materialize(texts.select("row", "text").mapInArrow(tidied(_places(window, anchor)), f"row long, {_PLACE}"), "anchors")

    def fetch(one: DataFrame) -> DataFrame:
        wanted = one.groupBy("row").agg(F.collect_list(F.struct("at", "n", "cl", "cr", "key", "c1", "c2", "copies")).alias("wanted"))  # bounded by the text's own length
        return texts.join(wanted, "row").select("text", "wanted").mapInArrow(tidied(_cut_out(window)), "n int, cl int, cr int, key long, c1 long, c2 long, copies long, text binary")

    return _runs_of(places, ["row"], window, fetch, most)


def merged(runs: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Bytes that windows with such starts cover, as maximal stretches."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window - 1)
        else:
            out.append([a, b + window - 1])
    return [(a, b) for a, b in out]


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            spans, kept = [], []
            for text, runs in zip(raw_texts(batch.column("text")), batch.column("runs").to_pylist()):
                cut = merged([(r["start"], r["stop"]) for r in runs or []], window)
                edges = [0, *(x for s in cut for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in cut])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, raw_texts(batch.column("text"))), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST_STRETCHES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the stretches that go, and the bytes that stay."""
    texts = _numbered(docs)
    runs = repeated_runs(texts, window, anchor, most)
    each = runs.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))  # bounded by the text's own length
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return texts.join(each, "row", "left").select("doc_id", "text", "runs").mapInArrow(tidied(_kept(window)), f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return remove(docs, window).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
