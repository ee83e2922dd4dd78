"""LM scoring with an interpolated modified Kneser-Ney bigram model that is counted in Spark over all training texts.

Words are 64-bit hashes. Three passes over the texts:

1. Words are counted; shards are ranges of the hash, so all shards in a row are one sorted array.
2. Bigrams are counted. A shard holds whole contexts (by the first word's hash), save for the few very frequent first words,
   whose bigrams are dealt by both words: no shard grows with one word. Tasks send sorted, compressed blocks of distinct
   bigrams with their counts, so what is shuffled is pre-aggregated and no row is made for a single bigram. Each shard
   leaves sorted hash arrays, counts and context totals, and tells the word shards in how many contexts each word stands.
3. Scoring tasks memory-map the arrays, gather the tokens of about SCORE_TOKENS of text (a longer text stands alone) and look up
   their distinct words and bigrams shard by shard, so a shard is opened once a gathering, not once a few megabytes; a worker
   keeps MOST_OPEN shards open at most.

Beyond FAN shards, blocks go to ranges of shards first and are merged there, so a block never shrinks to a few n-grams.

A shard is one file in the shared folder, written to another name and then renamed, so a task that is run again after
an executor was lost replaces its file by the same contents. Workers map it where it is if the folder is mounted, and
map an unlinked local copy if it is in another store. Nothing that grows with the corpus reaches the driver.

Nulls and edges: a null or empty text is one end token; texts of any length are read whole; rows without doc_id are scored
and learned from like others; repeated rows count each time; with nothing to learn from every score is 0; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Memo, free_shuffles, give_back, materialize, new_folder, raw_texts, slices, tidied, words_of
from quillspark.llm.kn import _sums, discounts_of

#: Neither can be a word, as both are white space.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\n", b"\r"))
#: Tokens that a task gathers before it sends their distinct bigrams, tokens scored at a time (the latter take some 90 bytes of
#: memory each), and tokens a shard should hold.
GATHER, SCORE_TOKENS, SHARD_TOKENS = 2_000_000, 3_000_000, 1_250_000
#: Shards that blocks are dealt to directly, and shards that a worker keeps open.
FAN, MOST_OPEN = 1024, 128
#: A first word is dealt by both words if it is more than this share of all tokens (and a quarter of a shard).
FREQUENT = 1 / 1000


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A well-spread hash of one or two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b if isinstance(b, np.ndarray) else np.uint64(b))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


# --- arrays in the shared folder


def save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays of eight-byte or one-byte values as one file."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(np.array([len(arrays), *map(len, arrays)], np.int64).tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).data)
            out.write(bytes(-a.nbytes % 8))
    store.move(draft, f"{base}/{name}")


def load(folder: str, name: str, kinds: tuple[type, ...]) -> list[np.ndarray]:
    """The arrays of a file, over one map of it."""
    store, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    if isinstance(store, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with store.open_input_stream(path) as source, tempfile.TemporaryFile() as copy:
            while part := source.read(1 << 22):
                copy.write(part)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r")
    sizes, at, out = raw[8 : 8 + 8 * len(kinds)].view(np.int64).tolist(), 8 + 8 * len(kinds), []
    for kind, n in zip(kinds, sizes):
        length = n * np.dtype(kind).itemsize
        out.append(raw[at : at + length].view(kind))
        at += length + -length % 8
    return out


#: Arrays of each kind of file. Counts of 255 and more stand in `many` at the places `where`.
FILES = {
    "word": (np.uint64, np.int64),  # words, counts
    "stands": (np.int64,),  # contexts of each word of the word file
    "score": (np.uint64, np.float64),  # n-grams and probabilities of another model
    "pair": (np.uint64, np.uint8, np.int64, np.int64, np.uint64, np.float64),  # bigrams, counts, where, many, contexts, four sums a context
}


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for size, length in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, {4: np.uint32, 8: np.uint64}[size], length, at))
        at += size * length
    return out


# --- tokens


class Tokens:
    """Token hashes of texts laid end to end, each text closed by END."""

    def __init__(self) -> None:
        self.memo = Memo(xxhash.xxh64_intdigest)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, number of tokens of each text)."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in split], np.int64)
        out, at = np.empty(int(sizes.sum()), np.uint64), 0
        get = self.memo.__getitem__
        for ws, n in zip(split, sizes.tolist()):
            out[at : at + n - 1] = np.fromiter(map(get, ws), np.uint64, n - 1)
            at += n
        out[np.cumsum(sizes) - 1] = END
        return out, sizes


def contexts_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; BEGIN before a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return before


def _gathered(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    """Pass about GATHER tokens at a time, with their contexts, to emit, a function to (shard, blob) pairs."""
    reader, tokens, before, n = Tokens(), [], [], 0

    def rows() -> pa.RecordBatch:
        whole = np.concatenate(tokens)
        tokens.clear()
        contexts = np.concatenate(before)
        before.clear()
        shard, blob = zip(*emit(whole, contexts))
        return pa.record_batch([pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], ["shard", "blob"])

    for batch in slices(batches, "text"):
        t, sizes = reader.of(raw_texts(batch.column("text")))
        tokens.append(t)
        before.append(contexts_of(t, sizes))
        n += len(t)
        if n >= GATHER:
            yield rows()
            n = 0
            give_back()
    if n:
        yield rows()
    give_back()


def _by_shard(batches: Iterator[pa.RecordBatch]) -> dict[int, list[list[np.ndarray]]]:
    found: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
            found.setdefault(shard, []).append(_unpacked(blob))
    return found


def range_shard(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each word: ranges of equal width."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


@dataclass
class Model:
    """What scoring needs beside the arrays in the folder: sums, discounts and the few frequent contexts."""

    folder: str
    word_shards: int = 0
    shards: int = 0
    tokens: int = 0
    types: int = 0
    d_word: np.ndarray = field(default_factory=lambda: np.zeros(4))
    d_pair: np.ndarray = field(default_factory=lambda: np.zeros(4))
    distinct: int = 0  # bigrams
    word_backoff: float = 1.0
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    frequent_sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))  # total, contexts seen with count 1, 2, 3+


def _count_words(texts: DataFrame, folder: str, shards: int) -> DataFrame:
    """Write the word shards; (tokens, types, top) a shard, top its most frequent words."""

    width = -(-shards // FAN)

    def emit(tokens: np.ndarray, _: np.ndarray) -> Iterator[tuple[int, bytes]]:
        return _word_blobs(*np.unique(tokens, return_counts=True), shards, width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blobs in _by_shard(batches).items():
            words, n = _sums(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]).astype(np.int64))
            save(folder, f"word-{s}", words, n)
            top = np.argsort(-n, kind="stable")[: int(1 / FREQUENT)]
            tops = [{"w": w, "n": c} for w, c in zip(words[top].view(np.int64).tolist(), n[top].tolist())]
            yield pa.record_batch([pa.array([int(n.sum())]), pa.array([len(n)]), pa.array([tops], pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())])))], ["tokens", "types", "top"])

    sent = _fanned(texts.mapInArrow(lambda b: _gathered(b, emit), "shard int, blob binary"), width, _word_regroup(shards))
    return sent.repartitionById(shards, F.col("shard")).mapInArrow(merge, "tokens long, types long, top array<struct<w:long,n:long>>")


def _word_blobs(words: np.ndarray, n: np.ndarray, shards: int, width: int) -> Iterator[tuple[int, bytes]]:
    """(range of `width` shards, block) of sorted words with their figures."""
    group = range_shard(words, shards) // width
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    for a, b in zip(first, [*first[1:], len(group)]):
        yield int(group[a]), _packed(words[a:b], n[a:b].astype(np.uint64))


def _word_regroup(shards: int):
    def regroup(blobs: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        return _word_blobs(*_sums(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]).astype(np.int64)), shards, 1)

    return regroup


def _fanned(sent: DataFrame, width: int, regroup) -> DataFrame:
    """Blocks of single shards from blocks of ranges of `width` shards: each range is dealt to as many tasks, which merge what
    they get, about GATHER figures at a time."""
    if width == 1:
        return sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def rows() -> pa.RecordBatch:
            shard, blob = zip(*regroup(held))
            return pa.record_batch([pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], ["shard", "blob"])

        for batch in batches:
            for bucket, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
                if held and (bucket != now or size >= GATHER):
                    yield rows()
                    held, size = [], 0
                now = bucket
                held.append(_unpacked(blob))
                size += len(held[-1][-1])
        if held:
            yield rows()
        give_back()

    dealt = sent.withColumn("part", F.pmod(F.xxhash64("blob"), F.lit(width)))
    return dealt.repartition("shard", "part").sortWithinPartitions("shard").select("shard", "blob").mapInArrow(run, "shard int, blob binary")


def pair_shard(before: np.ndarray, words: np.ndarray, is_frequent: np.ndarray, shards: int) -> np.ndarray:
    return (np.where(is_frequent, mixed(before, words), mixed(before, 1)) % np.uint64(shards)).astype(np.int32)


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _count_pairs(texts: DataFrame, model: Model) -> DataFrame:
    """Write the bigram shards; rows of kind 'sum' (counts of counts), 'frequent' (context sums) and 'word' (blobs for word shards)."""
    folder, shards, word_shards, frequent = model.folder, model.shards, model.word_shards, model.frequent
    fan, word_fan = -(-shards // FAN), -(-word_shards // FAN)
    names = ["kind", "shard", "key", "a", "b", "c", "d", "blob"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def emit(tokens: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, bytes]]:
        local = np.unique(np.append(tokens, BEGIN))
        width = np.uint64(len(local))
        pair, n = np.unique(np.searchsorted(local, before).astype(np.uint64) * width + np.searchsorted(local, tokens).astype(np.uint64), return_counts=True)
        h, w = pair // width, pair % width
        shard = pair_shard(local[h], local[w], _member(frequent, local)[h], shards)
        return _pair_blobs(local, h, w, n.astype(np.uint32), shard // fan)

    def regroup(blobs: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        _, h, w, n = _summed(blobs)
        local = np.unique(np.concatenate([h, w]))
        return _pair_blobs(local, np.searchsorted(local, h), np.searchsorted(local, w), n.astype(np.uint64), pair_shard(h, w, _member(frequent, h), shards))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blobs in _by_shard(batches).items():
            key, h, w, n = _summed(blobs)
            blobs.clear()
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            context, by = h[order][first], n[order]
            sums = np.column_stack([np.add.reduceat(by, first), *(np.add.reduceat((by == k if k < 3 else by >= 3).astype(np.int64), first) for k in (1, 2, 3))])
            often = _member(frequent, context)
            where = np.flatnonzero(n >= 255)
            save(folder, f"pair-{s}", key, np.minimum(n, 255).astype(np.uint8), where, n[where], context[~often], sums[~often].astype(np.float64).ravel())
            rows = [("sum", s, len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4)), None)]
            rows += [("frequent", s, k, *x, None) for k, x in zip(context[often].view(np.int64).tolist(), sums[often].tolist())]
            words, seen = np.unique(w, return_counts=True)
            rows += [("word", t, None, None, None, None, None, blob) for t, blob in _word_blobs(words, seen, word_shards, word_fan)]
            del key, h, w, n, order, first, by, sums, words, seen
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            del rows
            give_back()

    sent = _fanned(texts.mapInArrow(lambda b: _gathered(b, emit), "shard int, blob binary"), fan, regroup)
    schema = "kind string, shard int, key long, a long, b long, c long, d long, blob binary"
    return sent.repartitionById(shards, F.col("shard")).mapInArrow(merge, schema)


def _pair_blobs(local: np.ndarray, h: np.ndarray, w: np.ndarray, n: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(group, block) of distinct bigrams, given as places in `local`."""
    if not len(group):
        return
    order = np.argsort(group.astype(np.uint16) if group.max() < 1 << 16 else group, kind="stable")
    sorted_group = group[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
    for a, b in zip(first, [*first[1:], len(order)]):
        part = order[a:b]
        one, hs = np.unique(h[part], return_inverse=True)
        two, ws = np.unique(w[part], return_inverse=True)
        yield int(sorted_group[a]), _packed(local[one], local[two], hs.astype(np.uint32), ws.astype(np.uint32), n[part])


def _summed(blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, second word, count) of the distinct bigrams of some blocks, by key."""
    h = np.concatenate([b[0][b[2]] for b in blobs])
    w = np.concatenate([b[1][b[3]] for b in blobs])
    n = np.concatenate([b[4] for b in blobs]).astype(np.int64)
    key = mixed(h, w)
    order = np.argsort(key, kind="stable")
    key, h, w, n = key[order], h[order], w[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], h[first], w[first], np.add.reduceat(n, first)


def _count_contexts(rows: DataFrame, model: Model) -> DataFrame:
    """Write in how many contexts each word stands; counts of these counts a shard."""
    folder = model.folder

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blobs in _by_shard(batches).items():
            words, seen = _sums(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]).astype(np.int64))
            known = load(folder, f"word-{s}", FILES["word"])[0]
            out = np.zeros(len(known), np.int64)
            out[np.searchsorted(known, words)] = seen
            save(folder, f"stands-{s}", out)
            yield pa.record_batch([pa.array([int((seen == k).sum() if k < 5 else seen.sum())]) for k in (1, 2, 3, 4, 5)] + [pa.array([int((seen >= 3).sum())])], list("abcdef"))

    sent = _fanned(rows.where("kind = 'word'").select("shard", "blob"), -(-model.word_shards // FAN), _word_regroup(model.word_shards)).repartitionById(model.word_shards, F.col("shard"))
    return sent.mapInArrow(merge, "a long, b long, c long, d long, e long, f long")


def fit(docs: DataFrame, is_training: Column, least_shards: int = 1) -> Model:
    """Count the model over all rows that the condition holds for; bigram shards follow the number of tokens."""
    spark = docs.sparkSession
    texts = docs.where(is_training).select("text")
    model = Model(new_folder(spark, "lm"))
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    model.word_shards = max(conf, min(1 << 15, size >> 25) if size < 1 << 60 else 0)  # beyond that the size is unknown
    words = materialize(_count_words(texts, model.folder, model.word_shards), "lm-words")
    sums = words.agg(F.sum("tokens"), F.sum("types")).first()
    if not sums[0]:
        return model
    model.tokens, model.types = sums
    model.shards = max(conf, least_shards, -(-model.tokens // SHARD_TOKENS))
    least = max(model.tokens * FREQUENT, model.tokens / (4 * model.shards))
    top = words.select(F.explode("top").alias("t")).where(F.col("t.n") >= least).select("t.w").collect()
    begins = docs.where(is_training).count()  # contexts of first words
    frequent = {r["w"] for r in top} | ({int(BEGIN.view(np.int64))} if begins >= least else set())
    model.frequent = np.sort(np.array(list(frequent), np.int64).view(np.uint64))

    rows = materialize(_count_pairs(texts, model), "lm-pairs")
    free_shuffles(spark)
    n = rows.where("kind = 'sum'").agg(*(F.sum(x) for x in ("key", "a", "b", "c", "d"))).first()
    model.distinct, model.d_pair = n[0], discounts_of(*n[1:])
    parts = {r["key"]: r for r in rows.where("kind = 'frequent'").groupBy("key").agg(*(F.sum(x).alias(x) for x in "abcd")).collect()}
    model.frequent = np.sort(np.array(list(parts), np.int64).view(np.uint64)) if parts else np.zeros(0, np.uint64)
    model.frequent_sums = np.array([[parts[k][x] for x in "abcd"] for k in model.frequent.view(np.int64).tolist()], np.float64).reshape(-1, 4)
    n = _count_contexts(rows, model).agg(*(F.sum(x) for x in "abcdef")).first()
    model.d_word = discounts_of(*n[:4])
    model.word_backoff = float(model.d_word[1] * n[0] + model.d_word[2] * n[1] + model.d_word[3] * n[5]) / model.distinct
    free_shuffles(spark)
    return model


class Reader:
    """The mapped arrays, in a worker; the shards used last stay open."""

    def __init__(self, model: Model):
        self.model, self.open = model, OrderedDict()

    def arrays(self, kind: str, shard: int) -> list[np.ndarray]:
        name = f"{kind}-{shard}"
        if name in self.open:
            self.open.move_to_end(name)
        else:
            if len(self.open) >= MOST_OPEN:
                self.open.popitem(last=False)
            try:
                self.open[name] = load(self.model.folder, name, FILES[kind])
            except FileNotFoundError:  # nothing fell into this shard
                self.open[name] = [np.zeros(0, k) for k in FILES[kind]]
        return self.open[name]

    def each(self, keys: np.ndarray, shard: np.ndarray, kind: str, at: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, which keys stand in its array number `at`, at which places)."""
        order = np.argsort(shard, kind="stable")
        ranked = shard[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else []
        for a, b in zip(first, [*first[1:], len(order)]):
            own, have = order[a:b], self.arrays(kind, int(ranked[a]))[at]
            if len(have):
                place = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
                hit = have[place] == keys[own]
                yield int(ranked[a]), own[hit], place[hit]

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, contexts) of sorted distinct words."""
        n, stands = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for s, own, at in self.each(words, range_shard(words, self.model.word_shards), "word"):
            n[own], stands[own] = self.arrays("word", s)[1][at], self.arrays("stands", s)[0][at]
        return n, stands

    def looked_up(self, words: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((total, backoff weight) of each of the words as a context, total 0 if unknown; count of each bigram before, after)."""
        m, sums, counts = self.model, np.zeros((len(words), 4)), np.zeros(len(before), np.int64)
        often = _member(m.frequent, words)
        sums[often] = m.frequent_sums[np.searchsorted(m.frequent, words[often])]
        rest = np.flatnonzero(~often)
        for s, own, at in self.each(words[rest], (mixed(words[rest], 1) % np.uint64(m.shards)).astype(np.int32), "pair", 4):
            sums[rest[own]] = self.arrays("pair", s)[5].reshape(-1, 4)[at]
        key = mixed(before, after)
        order = np.argsort(key)
        shard = pair_shard(before, after, _member(m.frequent, before), m.shards)[order]
        for s, own, at in self.each(key[order], shard, "pair"):
            _, few, where, many, _, _ = self.arrays("pair", s)
            found = few[at].astype(np.int64)
            if (large := found == 255).any():
                found[large] = many[np.searchsorted(where, at[large])]
            counts[order[own]] = found
        total = sums[:, 0]
        return np.column_stack([total, sums[:, 1:] @ m.d_pair[1:] / np.where(total > 0, total, 1)]), counts

    def score(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, base score, model score (log10)."""
        m = self.model
        if not m.tokens:
            zero = np.zeros(len(sizes))
            return zero.astype(np.int64), zero, zero
        local, token = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        begin, token = token[-1], token[:-1]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[np.cumsum(sizes) - sizes] = begin
        n, stands = self.words(local)
        base = np.log10((n + 1) / (m.tokens + m.types + 1))
        low = (stands - m.d_word[np.minimum(stands, 3)]) / m.distinct + m.word_backoff / (m.types + 1)
        pair, back = np.unique(before * len(local) + token, return_inverse=True)
        h, w = np.divmod(pair, len(local))
        context, c = self.looked_up(local, local[h], local[w])
        total, weight = context[h, 0], context[h, 1]
        p = np.where(total > 0, (c - m.d_pair[np.minimum(c, 3)]) / np.where(total > 0, total, 1) + weight * low[w], low[w])
        starts = np.cumsum(sizes) - sizes
        return tuple(np.add.reduceat(x, starts) for x in ((n > 0)[token].astype(np.int64), base[token], np.log10(p)[back]))


SCORES = ["doc_id", "n_tokens", "n_known", "base_score", "score"]


def scored(batches: Iterator[pa.RecordBatch], arrays: Reader) -> Iterator[pa.RecordBatch]:
    """The scores of (doc_id, text) batches, about SCORE_TOKENS tokens at a time."""
    reader, ids, tokens, sizes, n = Tokens(), [], [], [], 0

    def rows() -> pa.RecordBatch:
        whole, own = np.concatenate(tokens), np.concatenate(sizes)
        tokens.clear()
        out = pa.record_batch([pa.concat_arrays(ids), pa.array(own), *map(pa.array, arrays.score(whole, own))], SCORES)
        ids.clear()
        sizes.clear()
        return out

    for batch in slices(batches, "text"):
        t, s = reader.of(raw_texts(batch.column("text")))
        ids.append(batch.column("doc_id"))
        tokens.append(t)
        sizes.append(s)
        n += len(t)
        if n >= SCORE_TOKENS:
            yield rows()
            n = 0
            give_back()
    if n:  # an empty text has a token too
        yield rows()
    give_back()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): one row a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored(batches, Reader(model))

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
