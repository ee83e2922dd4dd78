"""Vector code compression: integer product quantisation whose assignment is an Exponion search.

A vector's components become integers floor(scale * x) and are cut into equal consecutive parts. Each part position has a
codebook, at first that part of the rows of smallest id; every round assigns all parts to their nearest entry and moves
each entry to the componentwise floor(sum / count) of its parts. An entry that no part chose stays.

*Search.* A part starts at the entry it had before (in the first round at the best of a few spread entries). Let u be its
distance there. An entry at distance d from that entry is at least d - u from the part, so only entries with d <= 2u can be
as near: a prefix of the neighbour list of the entry it started at, which is sorted by distance. All distances are exact
integers (4u^2 is compared with d^2, both whole), and the least index wins a tie, so the radius holds every tied entry too.

*Spark.* A round is one narrow pass over the vectors: each task assigns its rows and gives one row of sums for each entry
that it met, written beside the rows to the shared folder; nothing of a vector is shuffled. Sums are added by part, entry
and position. The driver holds codebooks only, at most 256 entries of a vector's length, which are also what is broadcast.

Nulls and edges: rows whose vector is null or holds null or non-finite components are left out; a null id comes last in
the order of the first rows, repeated ids go by their components. Vectors shorter than the longest, or of a length that the
number of parts does not divide, are filled up with zeros. Fewer rows than entries give smaller codebooks, no rows an empty
result. A component beyond 64 bits counts as the nearest 64-bit number, an error beyond them as the largest. Null labels are one
label. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import discard, materialize, tidied

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Every so many entries one is tried as the first start of a part.
SPREAD = 16
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """entries[part][index] is a tuple of whole components."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def width(self) -> int:
        return len(self.entries[0][0])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def decode(self, code: bytes) -> list[int]:
        """The vector that a code stands for."""
        return [x for part, i in zip(self.entries, code) for x in part[i]]


def exact(*arrays: np.ndarray) -> type:
    """The narrowest type in which squared distances between rows of the arrays are exact."""
    width = max(a.shape[-1] for a in arrays)
    far = 2 * max(max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0 for a in arrays)
    bound = width * far * far
    return np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object


class Exponion:
    """Nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.as_type: dict[type, tuple[np.ndarray, np.ndarray]] = {}
        apart = self.distances(entries, np.arange(len(entries)), exact(entries))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def typed(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.as_type:
            e = self.entries.astype(kind)
            self.as_type[kind] = e, (e * e).sum(axis=1)
        return self.as_type[kind]

    def distances(self, points: np.ndarray, of: np.ndarray, kind: type) -> np.ndarray:
        """Squared distances of points (rows) to the entries numbered `of` (columns)."""
        e, square = self.typed(kind)
        p = points.astype(kind, copy=False)
        return (p * p).sum(axis=1)[:, None] - 2 * (p @ e[of].T) + square[of][None, :]

    def nearest(self, points: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, the least index of equals."""
        kind = exact(points, self.entries)
        p = points.astype(kind)
        if start is None:
            tried = np.arange(0, len(self.entries), SPREAD)
            start = tried[np.argmin(self.distances(p, tried, kind), axis=1)]
        gap = p - self.typed(kind)[0][start]
        here = (gap * gap).sum(axis=1)
        index, least = np.empty(len(p), np.int64), np.empty(len(p), kind)
        by_start = np.argsort(start, kind="stable")
        cuts = np.flatnonzero(np.diff(start[by_start])) + 1
        for own in np.split(by_start, cuts) if len(p) else []:
            a = start[own[0]]
            reach = np.searchsorted(self.apart[a], 4 * here[own], side="right")
            ring = np.frexp(reach.astype(np.float64))[1]  # points whose radius holds about as many entries go together
            for size in np.unique(ring):
                some = own[ring == size]
                near = np.sort(self.order[a][: reach[ring == size].max()])
                found = self.distances(p[some], near, kind)
                best = np.argmin(found, axis=1)
                index[some], least[some] = near[best], found[np.arange(len(some)), best]
        return index, least if kind is object else least.astype(np.int64)


def _books(books: Codebooks) -> list[Exponion]:
    return [Exponion(np.array([list(e) for e in part], np.int64).reshape(len(part), -1)) for part in books.entries]


def _vectors(batch: pa.RecordBatch, width: int, parts: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, parts, width)


def _assigned(books: list[Exponion], v: np.ndarray, code: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances."""
    before = None if code.null_count else np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), -1).astype(np.int64)
    found = [b.nearest(v[:, i], None if before is None else before[:, i]) for i, b in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1).astype(np.uint8), np.stack([f[1] for f in found], axis=1)


def _binary(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes], pa.binary())


_SUM = pa.decimal128(38, 0)


def _round(shared, width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their new codes, then a row of sums (count first) for each entry met."""
        books, totals, kinds = _books(shared.value), {}, None
        names = ["vec_id", "label", "v", "code", "part", "entry", "sums"]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = batch.schema
            v = _vectors(batch, width, parts)
            codes, _ = _assigned(books, v, batch.column("code"))
            safe = v if n * max(abs(int(v.max())), abs(int(v.min()))) < 2**62 else v.astype(object)
            for i in range(parts):
                order = np.argsort(codes[:, i], kind="stable")
                had, first, count = np.unique(codes[order, i], return_index=True, return_counts=True)
                for entry, c, s in zip(had.tolist(), count.tolist(), np.add.reduceat(safe[order, i], first, axis=0)):
                    new = np.array([c, *s.tolist()], object)
                    totals[i, entry] = totals[i, entry] + new if (i, entry) in totals else new
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.list_(_SUM))]
            yield pa.record_batch([*(batch.column(c) for c in names[:3]), _binary(codes), *none], names)
        if totals:
            n = len(totals)
            own = [pa.nulls(n, kinds.field(c).type) for c in names[:4]]
            part, entry = zip(*totals)
            sums = pa.array([[int(x) for x in s] for s in totals.values()], pa.list_(_SUM))
            yield pa.record_batch([*own, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), sums], names)

    return run


def _last(shared, width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(shared.value)
        for batch in batches:
            if batch.num_rows:
                codes, far = _assigned(books, _vectors(batch, width, parts), batch.column("code"))
                error = pa.array([min(int(x), LARGEST) for x in far.astype(object).sum(axis=1)], pa.int64())
                yield pa.record_batch([batch.column("vec_id"), batch.column("label"), _binary(codes), error], ["vec_id", "label", "code", "error"])

    return run


def whole_parts(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """((vec_id, label, v, code), width of a part): whole components, filled up to one length; code is null."""
    x = F.col("embedding")
    fit = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select("vec_id", "label", "embedding").where(fit)
    width = max(1, -(-(kept.agg(F.max(F.size(x))).first()[0] or 0) // parts))
    unit = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    filled = F.concat(unit, F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size(x)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", filled.alias("v"), F.lit(None).cast("binary").alias("code")), width


def _first_books(rows: DataFrame, width: int, parts: int, entries: int) -> Codebooks | None:
    """That part of each of the rows of smallest id."""
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        return None
    return Codebooks(tuple(tuple(tuple(v[i * width : (i + 1) * width]) for v in first) for i in range(parts)))


def _moved(books: Codebooks, rows: DataFrame) -> Codebooks:
    """Each entry at the floor of its parts' mean; `rows` hold the tasks' sums."""
    each = rows.where("part IS NOT NULL").select("part", "entry", F.posexplode("sums").alias("at", "x"))
    added = each.groupBy("part", "entry", "at").agg(F.sum("x").cast("decimal(38,0)").alias("x"))
    whole = added.groupBy("part", "entry").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("sums"))
    entries = [list(part) for part in books.entries]
    for r in whole.collect():  # at most 256 entries a part
        count, *sums = (int(s.x) for s in r.sums)
        entries[r.part][r.entry] = tuple(s // count for s in sums)
    return Codebooks(tuple(map(tuple, entries)))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codebooks | None, DataFrame]:
    """(codebooks, (vec_id, label, code, error)): codes are one byte a part; errors are squared distances."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    typed = {f.name: f.dataType for f in vectors.select("vec_id", "label").schema}
    given, width = whole_parts(vectors, parts, scale)
    rows = materialize(given, "vectors")
    books = _first_books(rows, width, parts, entries)
    if books is None:
        empty = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", typed["label"]), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
        return None, spark.createDataFrame([], empty)
    kept = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        new = materialize(rows.select("vec_id", "label", "v", "code").mapInArrow(tidied(_round(shared, width, parts)), kept), "codes")
        discard(rows)
        shared.unpersist()
        books = _moved(books, new)
        rows = new.where("part IS NULL")
        rows._folder = new._folder
    shared = spark.sparkContext.broadcast(books)
    out = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    coded = materialize(rows.select("vec_id", "label", "v", "code").mapInArrow(tidied(_last(shared, width, parts)), out), "coded")
    discard(rows)
    return books, coded


def label_errors(coded: DataFrame) -> DataFrame:
    """(label, label_error): errors added by equal labels, nulls together."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    return coded.groupBy("label").agg(F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): the code in hex, two digits a part."""
    books, coded = fit(vectors, parts, entries, rounds, scale)
    totals = materialize(label_errors(coded), "labels").withColumnRenamed("label", "of")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
