"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt to shards of bounded size by a hash of their id. A shard sorts each dimension once. Queries come in
blocks of bounded size; for each query the lists are read in parallel from their better end (the largest values where the
query's component is positive, the smallest where it is negative), every id met is scored in full (random access), and
reading stops when the threshold, the score that a row unseen in all lists could reach at most, is below the kth score.
A threshold equal to the kth score doesn't stop it: such a row may have a smaller id. Lists are read some entries at a
time, which only means that a few more ids are scored than with one entry at a time.

Each (block, shard) gives at most k rows a query; the best k of these are taken by rank. A unit of work is a shard and a
block of queries; shards and blocks are of the same size, where the two kinds of copies are fewest, so what is shuffled
grows with candidates x queries / SHARD_ROWS. Vectors are compared with those of their own length.

Nulls and edges: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
a query row finds every row of its length but itself, so also rows that repeat its id, and each query row has results of its own;
ties go to the smaller id; fewer candidates than k give fewer rows, a length that occurs once gives none; between empty
vectors every product is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import materialize, tidied

#: Rows in a shard and queries in a block, on the average, and components that a shard holds; fixed whatever the size of the
#: table. A table of fewer shards than cores is cut into smaller ones of at least LEAST_ROWS.
SHARD_ROWS, SHARD_CELLS, LEAST_ROWS = 65_536, 4 << 20, 2048
MOST_TASKS = 100_000


def whole_units(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, v): components x as floor(scale * x), computed as double; rows that can take no part are left out. row tells
    rows apart, once the frame is written."""
    x = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    unit = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.select("vec_id", "embedding").where(fit).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), unit.alias("v"))


class Shard:
    """Sorted per-dimension lists over some candidates."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.v = rows[order], ids[order], vectors[order]
        rising = np.argsort(self.v, axis=0, kind="stable")
        self.rising = np.ascontiguousarray(rising.T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(self.v, rising, axis=0).T)
        self.reach = np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1])).astype(np.float64)
        self.as_type: dict[type, np.ndarray] = {np.int64: self.v}

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products of some rows, exact: in the narrowest type that holds every partial sum."""
        bound = float(np.abs(query).astype(np.float64) @ self.reach)
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**52 else np.int64
        if kind not in self.as_type:
            self.as_type[kind] = self.v.astype(kind)
        table, q = self.as_type[kind], query.astype(kind)
        if len(rows) * 4 > len(table):  # reading on is then cheaper than picking rows
            return (table @ q)[rows].astype(np.int64)
        return (table[rows] @ q).astype(np.int64)

    def top(self, own: int, query: np.ndarray, k: int, step: int = 64) -> list[tuple[int, int]]:
        """(id, score) of the k best rows other than `own`, best first."""
        n = len(self.ids)
        use = np.flatnonzero(query)
        if not len(use):  # every score is 0: the smallest ids win
            return [(int(i), 0) for i in self.ids[self.rows != own][:k]]
        weight, up = query[use], query[use] > 0
        high, low = use[up], use[~up]
        unseen, left = np.ones(n, bool), n
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        at = 0
        while left:
            to = min(n, at + step)
            met = np.zeros(n, bool)
            met[self.rising[high, n - to : n - at].ravel()] = True
            met[self.rising[low, at:to].ravel()] = True
            met &= unseen
            new = np.flatnonzero(met)
            if len(new):
                unseen[new] = False
                left -= len(new)
                score, ids = self.scores(new, query), self.ids[new]
                good = self.rows[new] != own
                if len(best) == k:
                    good &= score >= best[-1]
                elif len(new) > 4 * k + 4:
                    good &= score >= np.partition(score[good], -k)[-k] if good.sum() > k else good
                ids, score = np.concatenate([best_ids, ids[good]]), np.concatenate([best, score[good]])
                order = np.lexsort((ids, -score))[:k]
                best_ids, best = ids[order], score[order]
            last = np.where(up, self.values[use, n - to], self.values[use, to - 1])
            if to == n or len(best) == k and int(last @ weight) < best[-1]:
                break
            at, step = to, step * 2
        return list(zip(best_ids.tolist(), best.tolist()))


def _search(k: int, most: int = 50_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit of work, each unit's candidates first, then its queries."""
        now, held, shard = None, [], None
        out: list[tuple[int, int, int, int]] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            unit, asks, row, vid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "asks", "row", "vec_id"))
            starts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), n]
            for a, b in zip(starts, starts[1:]):
                flat = batch.column("v").slice(a, b - a).flatten().to_numpy()
                flat = flat.reshape(b - a, len(flat) // (b - a))
                if unit[a] != now:
                    now, held, shard = unit[a], [], None
                if not asks[a]:
                    held.append((row[a:b], vid[a:b], flat))
                    continue
                if not held:
                    continue
                shard = shard or Shard(*map(np.concatenate, zip(*held)))
                for i in range(a, b):
                    out += [(int(row[i]), int(vid[i]), c, s) for c, s in shard.top(int(row[i]), flat[i - a], k)]
                if len(out) >= most:
                    yield _rows(out)
                    out = []
        yield _rows(out)

    return run


def _rows(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    got = np.array(out, np.int64).reshape(-1, 4)
    return pa.record_batch([pa.array(got[:, i]) for i in range(4)], ["row", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query holds for, the k other rows of highest inner product."""
    spark = vectors.sparkSession
    units = materialize(whole_units(vectors), "vectors")
    at_once = 2 * spark.sparkContext.defaultParallelism
    sized = units.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_query).alias("asked")).where("asked > 0")
    whole = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(SHARD_CELLS) / F.greatest(F.col("n"), F.lit(1)))))
    shards = F.greatest(F.ceil(F.col("rows") / whole), F.least(F.lit(at_once), F.ceil(F.col("rows") / LEAST_ROWS)))
    sized = sized.select("n", shards.cast("int").alias("shards"), F.ceil(F.col("asked") / whole).cast("int").alias("blocks"))
    # each length's units follow those of the lengths below it
    before = F.sum(F.col("shards").cast("long") * F.col("blocks")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    sized = materialize(sized.withColumn("first", F.coalesce(before, F.lit(0))), "lengths")
    total = sized.agg(F.sum(F.col("shards").cast("long") * F.col("blocks"))).first()[0] or 1
    # a shard's rows go to the units of every block, a block's queries to those of every shard
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pick = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
    placed = units.join(sized, F.size("v") == F.col("n"))
    have = placed.select("*", pick("shards", 0).alias("shard"), every("blocks").alias("block"), F.lit(False).alias("asks"))
    want = placed.where(is_query).select("*", every("shards").alias("shard"), pick("blocks", 7).alias("block"), F.lit(True).alias("asks"))
    work = have.unionByName(want).select((F.col("first") + F.col("shard").cast("long") * F.col("blocks") + F.col("block")).alias("unit"), "asks", "row", "vec_id", "v")
    parts = min(total, MOST_TASKS)
    dealt = work.repartitionById(parts, F.pmod("unit", F.lit(parts)).cast("int")).sortWithinPartitions("unit", "asks")
    found = dealt.mapInArrow(tidied(_search(k)), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
