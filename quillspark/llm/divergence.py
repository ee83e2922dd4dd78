"""Source divergence audit: how far the term shares of a language's sources lie apart, and which terms set a source off.

*Counting.* A task counts the terms of its documents in radix tries over bytes, one a language. A leaf has a number, and its counters are
rows (leaf, source, occurrences, documents) of arrays that are added up as they grow. Tries of MOST_LEAVES leaves together are given out and
begun anew. A trie is walked in byte order, which is the order of UTF-8; a leaf goes out as one row with its counters packed.

*Merging.* Leaves are dealt by ranges of (language, term), so a range is a stretch of prefixes: a task merges the leaves of its range in a
trie and keeps the terms in at least so many of the language's documents. Each trie has one row for a term, so even the commonest has no
more rows than there were tries.

*Comparing.* Smoothed shares are whole numbers, p = 1 + floor(10^9 (count + 5) / (N + 5 V)). A source without a term has one share for all
of these, so only terms that occur are looked at: for sources a and b the sum over all V terms is V |p0(a) - p0(b)| plus, over the terms that one
of them has, |p(a) - p(b)| - |p0(a) - p0(b)|. A unit of work is two blocks of about BLOCK sources and a chunk of about CHUNK terms, walked in byte
order; it gives the sums of its pairs of sources and each source's best terms, ties to the lesser term. All pairs of sources are the result
itself; documents and terms are never paired.

Nulls and edges: a null text, language or source is ''; a group without terms or a language without kept terms still has its pairs
(0 in the latter); repeated rows count each; an empty table gives an empty result; extra columns are ignored; a term may be of any length.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import discard, materialize, raw_texts, slices, tidied

LEAST_DOCS, TOP, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
MOST_LEAVES, MOST_COUNTERS = 500_000, 1_000_000
BLOCK, CHUNK = 256, 4096
#: Letters A-Z lower-cased, a-z and all bytes of other scripts as they are, the rest as spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Node:
    __slots__ = ("edges", "leaf")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] | None = None
        self.leaf = -1


class Trie(dict):
    """A radix trie over bytes with numbered leaves; as a dict it remembers the leaf of each term that it has met."""

    def __init__(self) -> None:
        super().__init__()
        self.root, self.counters, self.new, self.more = Node(), np.empty((0, 4), np.int64), [], 0

    def __missing__(self, term: bytes) -> int:
        node, at, end = self.root, 0, len(term)
        while at < end:
            edges = node.edges
            if edges is None:
                edges = node.edges = {}
            edge = edges.get(term[at])
            if edge is None:
                node = Node()
                edges[term[at]] = term[at:], node
                break
            label, child = edge
            if not term.startswith(label, at):
                same, most = 1, min(len(label), end - at)
                while same < most and label[same] == term[at + same]:
                    same += 1
                middle = Node()
                middle.edges = {label[same]: (label[same:], child)}
                label, child = edges[term[at]] = label[:same], middle
            node, at = child, at + len(label)
        if node.leaf < 0:
            node.leaf = len(self)
        self[term] = node.leaf
        return node.leaf

    def add(self, counters: np.ndarray) -> None:
        """Rows (leaf, group, occurrences, documents)."""
        self.new.append(counters)
        self.more += len(counters)
        if self.more > MOST_COUNTERS:
            self.settle()

    def settle(self) -> np.ndarray:
        """All counters, one row for each leaf and group."""
        rows = np.concatenate([self.counters, *self.new])
        self.new, self.more = [], 0
        if len(rows):
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            rows = np.column_stack([rows[first, :2], np.add.reduceat(rows[:, 2:], first, axis=0)])
        self.counters = rows
        return rows

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf) in byte order."""
        stack = [(b"", self.root)]
        while stack:
            term, node = stack.pop()
            if node.leaf >= 0:
                yield term, node.leaf
            if node.edges:
                stack += [(term + node.edges[b][0], node.edges[b][1]) for b in sorted(node.edges, reverse=True)]

    def leaves(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(terms in byte order, their counters (group, occurrences, documents), number of counters of each)."""
        rows = self.settle()
        walked = list(self.walk())
        order = np.array([leaf for _, leaf in walked], np.int64)
        size = np.bincount(rows[:, 0], minlength=len(order))[order] if len(order) else order
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return [t for t, _ in walked], rows[np.argsort(rank[rows[:, 0]], kind="stable"), 1:], size


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _packed(lang: bytes, trie: Trie, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    terms, rows, size = trie.leaves()
    ends = np.cumsum(size)
    for a in range(0, len(terms), most):
        b = min(len(terms), a + most)
        first = ends[a] - size[a]
        offsets = np.concatenate([[first], ends[a:b]]) - first
        data = np.ascontiguousarray(rows[first : ends[b - 1]])
        blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((offsets * 24).astype(np.int32)), pa.py_buffer(data)])
        yield pa.record_batch([pa.array([lang] * (b - a), pa.binary()), pa.array(terms[a:b], pa.binary()), blobs], ["lang", "term", "counters"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gc.disable()  # tries hold no cycles, and each collection would walk all their nodes
    try:
        yield from _counted(batches)
    finally:
        gc.enable()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[bytes, Trie] = {}
    for batch in slices(batches, "text"):
        by_lang: dict[bytes, list[int]] = {}
        for i, lang in enumerate(raw_texts(batch.column("lang"))):
            by_lang.setdefault(lang, []).append(i)
        group, texts = batch.column("gid").to_numpy(), raw_texts(batch.column("text"))
        for lang, own in by_lang.items():
            trie = tries.setdefault(lang, Trie())
            terms = [terms_of(texts[i]) for i in own]
            size = [len(t) for t in terms]
            leaf = np.fromiter(map(trie.__getitem__, chain.from_iterable(terms)), np.int64, sum(size))
            if not len(leaf):
                continue
            met = np.sort(np.repeat(np.arange(len(own)), size) << 32 | leaf)
            first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))  # a document's terms, each once
            n = np.diff(np.append(first, len(met)))
            met = met[first]
            trie.add(np.column_stack([met & 0xFFFFFFFF, group[own][met >> 32], n, np.ones_like(n)]))
        if sum(map(len, tries.values())) > MOST_LEAVES:
            for lang in list(tries):
                yield from _packed(lang, tries.pop(lang))
    for lang in list(tries):
        yield from _packed(lang, tries.pop(lang))


_KEPT = "lang binary, term binary, gid long, n long, total long, first int"


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves sorted by language and term; the last of a batch may go on in the next."""
        lang, trie = None, Trie()
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang")
            cuts = [0, *(np.flatnonzero(pc.not_equal(langs[1:], langs[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if langs[a].as_py() != lang:
                    yield from _kept(lang, trie, least)
                    lang, trie = langs[a].as_py(), Trie()
                blobs = part.column("counters").to_pylist()
                rows = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 3)
                last = part.column("term")[-1].as_py()
                if last not in trie or len(trie) > 1:  # whole terms go out before the last one
                    leaf = [trie[t] for t in part.column("term").to_pylist()]
                    trie.add(np.column_stack([np.repeat(leaf, [len(x) // 24 for x in blobs]), rows]))
                    rest = trie.settle()
                    yield from _kept(lang, trie, least, but=last)
                    rest = rest[rest[:, 0] == trie[last]].copy()
                    trie = Trie()
                    rest[:, 0] = trie[last]
                    trie.add(rest)
                else:
                    trie.add(np.column_stack([np.full(len(rows), trie[last]), rows]))
        yield from _kept(lang, trie, least)

    return run


def _kept(lang: bytes | None, trie: Trie, least: int, but: bytes | None = None) -> Iterator[pa.RecordBatch]:
    """Counters of the terms in at least so many documents."""
    terms, rows, size = trie.leaves()
    if not len(rows):
        return
    first = np.cumsum(size) - size
    total, docs = np.add.reduceat(rows[:, 1], first), np.add.reduceat(rows[:, 2], first)
    good = (docs >= least) & np.array([t != but for t in terms])
    own = np.repeat(np.arange(len(terms)), size)
    of = np.flatnonzero(good[own])
    if len(of):
        begins = np.zeros(len(rows), np.int32)
        begins[first] = 1
        names = pa.array(terms, pa.binary()).take(pa.array(own[of]))
        yield pa.record_batch([pa.array([lang] * len(of), pa.binary()), names, pa.array(rows[of, 0]), pa.array(rows[of, 1]), pa.array(total[own[of]]), pa.array(begins[of])], ["lang", "term", "gid", "n", "total", "first"])


def kept_counts(docs: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(lang, term, gid, n, total, first): occurrences of the terms in at least so many documents of a language, in each group and
    in the language; first is 1 in one row of a term. Names are UTF-8 bytes; groups are (lang, source, gid)."""
    placed = docs.join(groups, ["lang", "source"]).select("lang", "gid", "text")
    tries = materialize(placed.mapInArrow(tidied(_count), "lang binary, term binary, counters binary"), "tries")
    dealt = tries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    found = materialize(dealt.mapInArrow(tidied(_merge(least)), _KEPT), "kept")
    discard(tries)
    return found


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact; 0 without kept terms."""
    whole = lambda c: c.cast("decimal(28,0)")
    above, below = whole(count + SMOOTH) * F.lit(UNIT), whole(total) + whole(kept) * SMOOTH
    return F.when(kept > 0, F.floor((above - above % below) / F.nullif(below, F.lit(0))).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def _compare(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit, each unit's groups before its terms, those in byte order."""
        now, unit = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), n]
            for a, b in zip(cuts, cuts[1:]):
                if ids[a] != now:
                    if unit:
                        yield unit.result()
                    now, unit = ids[a], _Unit(top)
                unit.take(batch.slice(a, b - a))
        if unit:
            yield unit.result()

    return run


class _Unit:
    """Two blocks of a language's groups (or one with itself) and a chunk of its terms."""

    def __init__(self, top: int) -> None:
        self.top, self.heads, self.open = top, [], None
        self.best: dict[int, list[tuple[int, bytes]]] = {}

    def take(self, batch: pa.RecordBatch) -> None:
        n_heads = batch.column("term").null_count
        if n_heads:
            self.heads += batch.slice(0, n_heads).select(["gid", "first", "second", "p", "kept"]).to_pylist()
        if n_heads == batch.num_rows:
            return
        if self.open is None:
            self.begin()
        batch = batch.slice(n_heads)
        term = batch.column("term")
        s = np.searchsorted(self.gids, batch.column("gid").to_numpy())
        p, q = batch.column("p").to_numpy(), batch.column("q").to_numpy()
        at = np.concatenate([[0], np.cumsum(pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))])
        count = int(at[-1]) + 1
        shares = np.tile(self.p0, (count, 1))
        if self.open[0] == term[0].as_py():  # the term goes on: its part of the sums is taken anew
            shares[0] = self.open[1]
            self.put(shares[:1], -1)
        shares[at, s] = p
        self.put(shares, 1)
        self.open = term[-1].as_py(), shares[-1].copy()
        good = np.flatnonzero((p > q) & self.both[s])
        good = good[np.lexsort((good, q[good] - p[good], s[good]))]
        own, first, size = np.unique(s[good], return_index=True, return_counts=True)
        for k, a, n in zip(own.tolist(), first.tolist(), size.tolist()):
            some = good[a : a + min(n, self.top)]
            found = self.best.get(k, []) + list(zip((q - p)[some].tolist(), term.take(pa.array(some)).to_pylist()))
            self.best[k] = sorted(found)[: self.top]

    def begin(self) -> None:
        self.heads.sort(key=lambda h: h["gid"])
        self.gids, self.p0 = (np.array([h[c] for h in self.heads], np.int64) for c in ("gid", "p"))
        self.both = np.array([h["first"] and h["second"] for h in self.heads], bool)
        self.sums = np.zeros((len(self.heads), len(self.heads)), np.int64)
        self.open = None, None

    def put(self, shares: np.ndarray, sign: int, most: int = 1 << 21) -> None:
        """Sums of |p(a) - p(b)| - |p0(a) - p0(b)| over the rows of shares, to add or to take back."""
        step = max(1, most // max(1, len(self.p0)))
        for i in range(0, len(shares), step):
            some = shares[i : i + step]
            for s in range(len(self.p0)):
                self.sums[s] += sign * (np.abs(some - some[:, s : s + 1]).sum(axis=0) - len(some) * np.abs(self.p0 - self.p0[s]))

    def result(self) -> pa.RecordBatch:
        if self.open is None:
            self.begin()
        out = []
        for s, a in enumerate(self.heads):
            for t, b in enumerate(self.heads):
                if s != t and (a["first"] and b["second"] or a["second"] and b["first"]):
                    out.append((a["gid"], b["gid"], None, int(self.sums[s, t]), a["kept"] * abs(a["p"] - b["p"])))
            out += [(a["gid"], None, term, -value, 0) for value, term in self.best.get(s, [])]
        cols = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], ["gid", "other", "term", "value", "base"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has the other sources of the language, the most different first,
    part 'term' the terms that the source has more of than its language, `top` at most."""
    bare = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("text", "lang", "source")))
    named = materialize(bare.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    own = kept_counts(bare, named, least_docs)
    sized = own.groupBy("gid").agg(F.sum("n").alias("size"))
    langs = own.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    widths = named.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(langs, "lang", "left")
    widths = widths.select("lang", "blocks", zero("kept"), zero("lang_size"), F.greatest(F.lit(1), F.ceil(zero("kept") / CHUNK)).cast("int").alias("chunks"))
    groups = named.join(widths, "lang").join(sized, "gid", "left").select("lang", "gid", zero("size"), "kept", "lang_size", "blocks", "chunks", F.pmod(F.xxhash64("gid"), "blocks").cast("int").alias("block"))
    groups = materialize(groups, "sizes")

    every_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine, other = F.col("block"), F.col("other")
    unit = F.concat_ws(":", F.hex("lang"), F.least(mine, other), F.greatest(mine, other), "chunk").alias("name")
    sides = [(mine <= other).alias("first"), (mine >= other).alias("second")]
    names = groups.select("*", every_of("blocks").alias("other")).select("*", every_of("chunks").alias("chunk"))
    none = F.lit(None).cast("binary").alias("term")
    heads = names.select(unit, "gid", *sides, none, share(F.lit(0), F.col("size"), F.col("kept")).alias("p"), F.lit(0).cast("long").alias("q"), "kept")
    placed = own.drop("first", "lang").join(groups, "gid").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).select("*", every_of("blocks").alias("other"))
    p, q = share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("kept")).alias("q")
    rows = placed.select(unit, "gid", *sides, "term", p, q, "kept")
    dealt = heads.unionByName(rows).repartition("name").sortWithinPartitions("name", F.col("term").asc_nulls_first())
    numbered = dealt.withColumn("unit", F.xxhash64("name")).drop("name")
    found = materialize(numbered.mapInArrow(tidied(_compare(top)), "gid long, other long, term binary, value long, base long"), "found")
    pairs = found.where("other IS NOT NULL").groupBy("gid", "other").agg((F.sum("value") + F.max("base")).alias("value"))
    text = lambda c: F.col(c).cast("string").alias(c)
    by_name = named.select("gid", text("lang"), text("source"))
    pairs = pairs.join(by_name.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other").withColumn("part", F.lit("pair"))
    terms = found.where("term IS NOT NULL").select("gid", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    best = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top), allowMissingColumns=True)
    return ranked.join(by_name, "gid").select("lang", "source", "part", "item", "value", "rank")
