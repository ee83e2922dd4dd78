"""Vector codes against plain integer k-means, and odd tables."""

import hashlib
import math

import pytest

from quillspark.llm import queries, veccode
from tests.oracle import ours, twin


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label); whole numbers of any size."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in {c[p] for c in chosen}:
                own = [cut(v, p) for (_, v, _), c in zip(kept, chosen) if c[p] == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
    errors, by_label = [sum(d for d, _ in f) for f in found], {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i is None, i or 0, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, _, label), f, err in zip(kept, found, errors))


def got(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


SCHEMA = "code string, vec_id long, embedding array<double>, label int, error string"


def frame(spark, rows):
    return spark.createDataFrame([("x", i, v, label, "y") for i, v, label in rows], SCHEMA)


def test_query_against_its_sql(spark, sf):
    assert ours(queries.op11_vector_codes(spark, sf)) == twin(queries.oracle_sql()["op11_vector_codes"], sf)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 0.1, 0.0], 1), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 2), (5, [None, 0.0, 0.0, 0.0], 2), (6, [0.5, -0.25, 0.1, 0.0], None)]
    rows += [(6, [0.1, 0.2, 0.3], None), (None, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (7, [], 7), (8, [1e9, -1e9, 3.0, 0.0], 8), (8, [1e9, -1e9, 3.0, 0.0], 8)]
    assert got(veccode.compress(frame(spark, rows))) == plain(rows)
    assert got(veccode.compress(frame(spark, rows), entries=3)) == plain(rows, entries=3)
    assert got(veccode.compress(frame(spark, [(1, [], 1)]))) == plain([(1, [], 1)])


def test_empty_table(spark):
    out = veccode.compress(frame(spark, []))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    assert veccode.compress(frame(spark, [(1, None, 1)])).count() == 0


def test_ties_go_to_the_least_index_and_codes_decode(spark):
    rows = [(i, [float(i % 4)] * 8, i % 3) for i in range(40)]
    books, coded = veccode.fit(frame(spark, rows))
    assert got(veccode.compress(frame(spark, rows))) == plain(rows)
    for r in coded.collect():
        assert books.decode(bytes(r.code)) == [1024 * (r.vec_id % 4)] * 8 and max(r.code) < 4


def test_search_skips_most_entries():
    import numpy as np

    rng = np.random.default_rng(5)
    entries = rng.integers(-1000, 1000, (256, 4))
    points = (entries[rng.integers(0, 256, 500)] + rng.integers(-9, 10, (500, 4))).astype(np.int64)
    search = veccode.Exponion(entries)
    looked = []
    search.distances = lambda p, of, kind, real=search.distances: looked.append(len(p) * len(of)) or real(p, of, kind)
    whole = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    start = whole.argmin(axis=1)
    index, far = search.nearest(points, start)
    assert (index == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
    assert sum(looked) < 0.1 * whole.size
    index, far = search.nearest(points, None)
    assert (index == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()


@pytest.mark.parametrize("size", [2**20, 2**28, 2**40])
def test_distances_are_exact_at_any_size(size):
    import numpy as np

    rng = np.random.default_rng(size)
    entries, points = rng.integers(-size, size, (9, 3)), rng.integers(-size, size, (50, 3))
    index, far = veccode.Exponion(entries).nearest(points, None)
    each = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in points]
    assert [int(x) for x in far] == [min(x) for x in each] and index.tolist() == [x.index(min(x)) for x in each]
