"""SimHash near-duplicates: fingerprints linked through sharded BK-trees, then connected components.

Fingerprints are compared only inside shards, the groups that agree on some blocks of bits: two fingerprints within the
radius must agree on at least one choice of blocks (pigeonhole), so no link is lost. Each shard is a BK-tree: children are
keyed by their integer Hamming distance to the parent, and a search follows only edges within the radius. The shuffle
brings each tree and its probes to one task; a driver-side broadcast of all trees would grow with the corpus. A shard above
`tree_rows` is cut into chunks, with one tree a chunk and every fingerprint of the shard probing every tree of it. A task
emits a spanning forest of its links, never all pairs, so dense groups of near copies cost linear output.

A small radius misses most pairs of a similarity of 0.8; further tables of fingerprints, from hashes mixed anew, give each
pair further chances to lie within it, at a cost linear in their number and without larger shards. Links are contracted to
component roots before further tables are searched: what is together already makes no more links.

`keep_unlike` takes the groups as candidates only: within a group, by doc_id, a document goes if the exact Jaccard similarity
of its word shingles with a document that stays reaches the bar. Documents of equal shingles are compared once. A round
decides the first HEADS members of every group, and holds what stays of them against the group's others, dealt over tasks;
a group of members that are all unlike takes a comparison a pair, as any exact check of it does.

Nulls and edges: a null or blank text has fingerprint 0, linked like any other; a null doc_id takes part and counts only
where no other member has an id; repeated rows come back once each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import discard, free_shuffles, materialize, raw_texts, slices, tidied, unused, words_of

_PIECE = 1 << 16
#: Large shards up to which their list is broadcast (24 bytes each), and tables of fingerprints searched in one pass.
MOST_BROADCAST, PASS_TABLES = 200_000, 3
#: Members of a group that a round decides among themselves, and their shingles (the first member may have more).
HEADS, HEAD_SHINGLES = 512, 1 << 22
#: Parts by which a group is ranked first.
RANK_PARTS = 64


def mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """The hashes of a further table: a bijective mix of the first table's, which are table 0."""
    if not table:
        return hashes
    z = hashes + np.uint64(table * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; a bit is 1 if set in over half of the hashes."""
    return table_fingerprints(text, width, 1)[0]


def _shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of `width` words, repeats included; fewer words are one shingle."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    if width == 3:
        return [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)))]


def table_fingerprints(text: bytes, width: int, tables: int) -> list[int]:
    """The text's SimHash in each table."""
    shingles = _shingles(words_of(text), width)
    if not shingles:
        return [0] * tables
    total, digest = np.zeros((tables, 64), np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), _PIECE):
        part = shingles[at : at + _PIECE]
        hashes = np.fromiter([digest(x, 42) for x in part], np.uint64, len(part))
        for t in range(tables):
            total[t] += np.unpackbits(mixed(hashes, t).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(shingles), axis=1).view(">u8")[:, 0].tolist()


def fingerprints(docs: DataFrame, width: int = 3, tables: int = 1) -> DataFrame:
    """(doc_id, fp, fp1, ..): the fingerprint of each table as a signed long."""
    kind = docs.schema["doc_id"].dataType
    names = ["fp", *(f"fp{t}" for t in range(1, tables))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([table_fingerprints(t, width, tables) for t in raw_texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(fps[:, t]) for t in range(tables))], ["doc_id", *names])

    schema = ", ".join([f"doc_id {kind.simpleString()}", *(f"{n} long" for n in names)])
    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


class BKTree:
    """Metric tree over 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, key: int) -> int:
        """Insert and return the node's number; a key that is there keeps its node."""
        if not self.keys:
            self.keys.append(key)
            self.kids.append({})
            return 0
        at = 0
        while d := (key ^ self.keys[at]).bit_count():
            down = self.kids[at].get(d)
            if down is None:
                self.kids[at][d] = len(self.keys)
                self.keys.append(key)
                self.kids.append({})
                return len(self.keys) - 1
            at = down
        return at

    def near(self, key: int, radius: int) -> list[int]:
        """Numbers of all nodes within the radius."""
        found, todo, keys, kids = [], [0] if self.keys else [], self.keys, self.kids
        while todo:
            at = todo.pop()
            d = (key ^ keys[at]).bit_count()
            if d <= radius:
                found.append(at)
            below = kids[at]
            if len(below) <= 2 * radius + 1:
                todo += [n for e, n in below.items() if -radius <= e - d <= radius]
            else:
                todo += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        return found


class Forest:
    """Union-find by the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, x: int, y: int) -> bool:
        """Put two members together; whether they were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


_ALL = (1 << 64) - 1
_signed = lambda x: x - (1 << 64) if x >> 63 else x


def shard_links(fps: list[int], roots: list[int], tree: list[bool], radius: int) -> list[tuple[int, int]]:
    """Spanning forest, over the members' roots, of the links in one shard; the search ends when all roots are together.

    tree: who stands in the tree; the others only probe."""
    bk, forest, owner, apart = BKTree(), Forest(), [], len(set(roots)) - 1
    for standing in (True, False):
        for x, root, own in zip(fps, roots, tree):
            if own is not standing:
                continue
            if not apart:
                return forest.edges()
            key = x & _ALL
            for n in bk.near(key, radius):
                apart -= forest.join(root, owner[n])
            if own and bk.add(key) == len(owner):
                owner.append(root)
    return forest.edges()


def _bk_links(radius: int):
    """Arrow function over rows sorted by shard: one BK-tree at a time, a spanning forest of links out."""
    names = ["key", "i", "j", "fp", "root", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:3]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            linked(cols, starts, out)
            held = [c[starts[-1] :] for c in cols]  # the next batch may go on with it
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if held is not None:
            linked(held, np.array([0, len(held[0])]), out)
        yield _edges(out)

    def linked(cols: list[np.ndarray], starts: np.ndarray, out: list[tuple[int, int]]) -> None:
        """Links of the shards between these starts; a shard of one root has none to find."""
        if len(starts) < 2:
            return
        fp, root, own = (c[: starts[-1]] for c in cols[3:])
        live = np.flatnonzero(np.minimum.reduceat(root, starts[:-1]) < np.maximum.reduceat(root, starts[:-1]))
        for a, b in zip(starts[live].tolist(), starts[live + 1].tolist()):
            out += shard_links(fp[a:b].tolist(), root[a:b].tolist(), own[a:b].tolist(), radius)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    got = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])


def block_masks(radius: int) -> list[int]:
    """Masks of the shard keys. With radius + k blocks, k of them are untouched by `radius` differing bits."""
    k = 1 if radius <= 2 else 2
    edge = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:])]
    return [_signed(sum(x)) for x in combinations(block, k)]


def link_edges(nodes: DataFrame, radius: int = 2, tree_rows: int = 4096) -> DataFrame:
    """(a, b), a > b: links within the radius between distinct fingerprints `fp`, a spanning forest for each shard.

    With a column `root` the links hold between the roots of the fingerprints, and those inside a root are left out; with a
    column `space` only fingerprints of the same space are compared. Shards above `tree_rows` are counted first, by a
    pre-aggregated count, and their rows are dealt to units of two chunks before any task holds them."""
    if "root" not in nodes.columns:
        nodes = nodes.withColumn("root", F.col("fp"))
    space = [F.col("space")] if "space" in nodes.columns else []
    keys = F.array(*[F.xxhash64(F.lit(t), *space, F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(block_masks(radius))])
    rows = nodes.select("fp", "root", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("live")).where(F.col("n") > tree_rows)
    large = materialize(sizes, "large-shards")
    n_large = large.count()
    if n_large:
        large = F.broadcast(large) if n_large <= MOST_BROADCAST else large
        rows = rows.join(large, "key", "left").where("n IS NULL OR live")
        chunks = F.coalesce(F.ceil(F.col("n") / tree_rows), F.lit(1)).cast("int")
        rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
        units = rows.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp", "root", (F.col("c") <= F.col("o")).alias("own"))
    else:
        units = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "root", F.lit(True).alias("own"))
    dealt = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(tidied(_bk_links(radius)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of the edges that isn't its component's smallest, and that smallest.

    Alternating large-star and small-star rounds: minima are pre-aggregated, joins are plain equi-joins that adaptive
    execution can split when a node has very many neighbours, and every round is written to the shared folder."""
    now, last, before = materialize(edges.where("a > b").select("a", "b").distinct(), "links"), None, None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if last is not None:
            discard(last)
        if not n or (n, mark) == before:
            return now
        before, last = (n, mark), now
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialize(small.select("e.a", "e.b").where("a > b").distinct(), "links")


def _merged(heads: DataFrame, roots: DataFrame, names: list[str], radius: int, tree_rows: int) -> DataFrame:
    """The roots (fp, root) after the links that these tables' fingerprints make.

    Roots that share one fingerprint are linked to the smallest of them; links to other fingerprints hold between these
    smallest, so a group that is together already takes part as one node a fingerprint and makes no further links."""
    owned = F.array(*[F.struct(F.lit(i).alias("space"), F.col(x).alias("fp")) for i, x in enumerate(names)])
    nodes = heads.join(roots, "fp").select("root", F.explode(owned).alias("o")).select("o.space", "o.fp", "root").distinct()
    nodes = materialize(nodes, "nodes") if names != ["fp"] else nodes
    least = nodes.groupBy("space", "fp").agg(F.min("root").alias("m"), F.max("root").alias("x"))
    links = link_edges(least.select("space", "fp", F.col("m").alias("root")), radius, tree_rows)
    if names != ["fp"]:
        inner = nodes.join(materialize(least.where("m < x"), "several-roots"), ["space", "fp"])
        links = links.unionByName(inner.select(F.col("root").alias("a"), F.col("m").alias("b")))
    stars = components(links)
    found = stars.select(F.col("a").alias("root"), F.col("b").alias("least"))
    now = materialize(roots.join(found, "root", "left").select("fp", F.coalesce("least", "root").alias("root")), "roots")
    discard(stars, roots, nodes)
    return now


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, tree_rows: int = 4096, tables: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row a document with the smallest doc_id it is linked to, itself included.

    With several tables, documents are linked that are within the radius in any of them. The first table's links are
    contracted to roots before the others are searched, PASS_TABLES at a time."""
    spark = docs.sparkSession
    marked = materialize(fingerprints(docs, width, tables), "simhash")
    names = ["fp", *(f"fp{t}" for t in range(1, tables))]
    heads = materialize(marked.select(*names).distinct(), "heads") if tables > 1 else marked.select("fp").distinct()
    roots = heads.select("fp").distinct().withColumn("root", F.col("fp"))
    for part in [names[:1], *(names[i : i + PASS_TABLES] for i in range(1, tables, PASS_TABLES))]:
        roots = _merged(heads, roots, part, radius, tree_rows)
        free_shuffles(spark)
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("d")).join(roots, "fp").groupBy("root").agg(F.min("d").alias("component_id")), "least")
    classes = materialize(roots.join(least, "root").select("fp", "component_id"), "classes")
    discard(heads, roots, least)
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2, tables: int = 1) -> DataFrame:
    """The documents that stand for their group, those with its smallest doc_id.

    Rows that repeat both doc_id and text stay once; rows without a doc_id stay, as no decision can reach them."""
    classes = near_duplicates(docs, width, radius, tables=tables).groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    kept_id, n = unused(docs, "kept_id"), unused(docs, "n_rows")
    kept = materialize(classes.where("c = doc_id").select(F.col("doc_id").alias(kept_id), F.col("n").alias(n)), "kept")
    found = docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col(kept_id)).drop(kept_id)
    again = found.where(F.col(n) > 1).drop(n).dropDuplicates(["doc_id", "text"])
    return found.where(F.col(n) == 1).drop(n).unionByName(again).unionByName(docs.where("doc_id is null"))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Hashes of a text's distinct word shingles, in order; a blank text has none."""
    shingles = _shingles(words_of(text), width)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


class Sets:
    """Shingle sets that others are held against, all at once."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.bar, self.sizes = Fraction(str(similarity)), np.array([len(x) for x in sets], np.int64)
        keys = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]

    def alike(self, x: np.ndarray) -> np.ndarray:
        """Which sets have at least the Jaccard similarity to x; two empty sets are alike."""
        left = np.searchsorted(self.keys, x, "left")
        count = np.searchsorted(self.keys, x, "right") - left
        at = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        return common * self.bar.denominator >= (self.sizes + len(x) - common) * self.bar.numerator


def first_unlike(sets: list[np.ndarray], similarity: float) -> list[int]:
    """Numbers of the sets that stay: in order, each that is not alike to one that stays before it."""
    index, gone, kept = Sets(sets, similarity), np.zeros(len(sets), bool), []
    for i, x in enumerate(sets):
        if not gone[i]:
            kept.append(i)
            if i + 1 < len(sets):
                gone |= index.alike(x)
    return kept


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(values, from, to) of runs of rows that agree in these columns."""
    keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
    a = 0
    for b in range(1, len(keys) + 1):
        if b == len(keys) or keys[b] != keys[a]:
            yield keys[a], a, b
            a = b


def _heads(similarity: float):
    """Arrow function over rows sorted by group and order: the members that stay. At most HEADS rows a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for c, a, b in _runs(batch, ["c"]):
                if c != group and held:
                    yield from stay(held)
                    held = []
                group = c
                held.append(batch.slice(a, b - a))
        if held:
            yield from stay(held)

    def stay(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from whole.take(first_unlike([x for b in held for x in _sets_of(b)], similarity)).to_batches()

    return run


def _others(similarity: float):
    """Arrow function over rows sorted by group, part and kind, what stays (`head`) first: the others unlike all of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, index = None, [], None
        for batch in batches:
            sets, out = _sets_of(batch), []
            for (c, part, head), a, b in _runs(batch, ["c", "part", "head"]):
                if (c, part) != group:
                    group, heads, index = (c, part), [], None
                if head:
                    heads += sets[a:b]
                    continue
                index = index or Sets(heads, similarity)
                out += [i for i in range(a, b) if not index.alike(sets[i]).any()]
            yield batch.take(pa.array(out, pa.int64())).select(["c", "doc_id", "h", "n", "shingles"])

    return run


def unlike(members: DataFrame, similarity: float, width: int = 5, part_rows: int = 2048) -> DataFrame:
    """(doc_id, h): the rows that stay, of members (c, doc_id, h, text): c is the group, h with doc_id names a row."""
    spark, kind = members.sparkSession, members.schema["doc_id"].dataType.simpleString()
    schema = f"c {kind}, doc_id {kind}, h long, n long, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, width) for t in raw_texts(batch.column("text"))]
            cols = [pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            yield pa.record_batch([*(batch.column(x) for x in ("c", "doc_id", "h")), *cols, same], ["c", "doc_id", "h", "n", "shingles", "same"])

    texts = members.select("c", "doc_id", "h", "text")
    alone = texts.groupBy("c", F.md5(F.coalesce("text", F.lit(""))).alias("own")).agg(F.min(F.struct("doc_id", "h")).alias("f")).select("f.doc_id", "f.h")
    alone = materialize(alone, "distinct-texts")
    texts = texts.join(alone, ["doc_id", "h"], "left_semi").select("c", "doc_id", "h", "text")
    sets = materialize(texts.mapInArrow(tidied(run), f"{schema}, same binary"), "shingles")
    first = sets.groupBy("c", "same").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("f.doc_id", "f.h")
    left = materialize(sets.drop("same").join(first, ["doc_id", "h"], "left_semi").select("c", "doc_id", "h", "n", "shingles"), "left")
    discard(alone, sets)
    kept = None
    while True:
        # a group's first members by parts, then the first of these: no task ranks a whole large group
        ranked = left.select("c", "doc_id", "h", "n", F.pmod(F.xxhash64("doc_id", "h"), F.lit(RANK_PARTS)).alias("p"))
        for by in (["c", "p"], ["c"]):
            order = Window.partitionBy(*by).orderBy("doc_id", "h")
            ranked = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= HEADS)
        ranked = ranked.withColumn("to", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("r") == 1) | (F.col("to") <= HEAD_SHINGLES))
        ids = materialize(ranked.select("c", "doc_id", "h"), "head-ids")
        heads = left.join(ids.select("doc_id", "h"), ["doc_id", "h"], "left_semi").select("c", "doc_id", "h", "n", "shingles")
        stay = materialize(heads.repartition("c").sortWithinPartitions("c", "doc_id", "h").mapInArrow(tidied(_heads(similarity)), schema), "stay")
        own = materialize(stay.select("doc_id", "h"), "kept")
        kept = own if kept is None else kept.unionByName(own)
        if ids.count() == left.count():
            discard(ids, stay, left)
            return kept
        rest = left.join(ids.select("doc_id", "h"), ["doc_id", "h"], "left_anti")
        parts = materialize(rest.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")), "parts")
        dealt = rest.join(parts, "c").withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.col("parts")).cast("int")).withColumn("head", F.lit(False))
        held = stay.join(parts, "c").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("head", F.lit(True))
        both = dealt.unionByName(held).select("c", "part", "head", "doc_id", "h", "n", "shingles")
        both = both.repartition("c", "part").sortWithinPartitions("c", "part", F.desc("head"))
        now = materialize(both.mapInArrow(tidied(_others(similarity)), schema), "left")
        discard(ids, stay, left, parts)
        left = now
        free_shuffles(spark)


def keep_unlike(docs: DataFrame, similarity: float, width: int = 3, radius: int = 2, tables: int = 1) -> DataFrame:
    """The documents without those that are at least so similar (5-word shingles) to one of their group that stays.

    Rows that repeat both doc_id and text stay once; rows without a doc_id stay, as no decision can reach them."""
    groups = near_duplicates(docs, width, radius, tables=tables).where("doc_id is not null")
    groups = materialize(groups.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n")), "groups")
    free_shuffles(docs.sparkSession)
    several = materialize(groups.groupBy("c").agg(F.sum("n").alias("rows")).where("rows > 1").select("c"), "several")
    own_id, group = unused(docs, "own_id"), unused(docs, "own_group")
    found = materialize(groups.join(several, "c", "left_semi").select(F.col("doc_id").alias(own_id), F.col("c").alias(group)), "suspects")
    # the texts are shuffled once, and whole rows are written beside their groups
    tagged = materialize(docs.join(found.hint("shuffle_hash"), F.col("doc_id") == F.col(own_id), "left").drop(own_id), "tagged")
    free_shuffles(docs.sparkSession)
    row = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")
    members = tagged.where(F.col(group).isNotNull()).select(F.col(group).alias("c"), "doc_id", F.xxhash64("text").alias("h"), "text", row)
    members = materialize(members.dropDuplicates(["doc_id", "text"]), "members")
    discard(groups, several, found)
    stay = members.join(unlike(members, similarity), ["doc_id", "h"], "left_semi").select("row.*")
    return tagged.where(F.col(group).isNull()).drop(group).unionByName(stay)
