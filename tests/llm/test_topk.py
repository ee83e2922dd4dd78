import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, topk
from tests import oracle

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asks, k):
    units = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(units):
        if asks(q):
            got = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(units) if m != n and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [16_384, 60, 7])
def test_same_as_brute_force_with_ties_and_holes(spark, shard_rows):
    rng = random.Random(8)
    base = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(30)]
    rows = [(i, rng.choice(base) if rng.random() < 0.6 else [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(301, None), (350, [None] * 8), (400, [float("nan")] * 8), (450, [float("inf")] + [0.0] * 7), (500, [0.0] * 8), (550, []), (-50, base[0])]
    rows += [(600, [0.5, 0.25, 1.0]), (8, [1.0, 1.0, 1.0]), (601, [0.5, 0.5]), (650, []), (0, base[1]), (0, base[2]), (50, base[3])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("score", F.lit("clash"))
    got = topk.search(df, F.col("vec_id") % 50 == 0, 5, shard_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0, 5)


def test_the_bound_stops_the_reading_early():
    rng = np.random.default_rng(2)
    v = np.zeros((5000, 4), np.int64)
    v[:, 0] = rng.permutation(5000)
    s = topk.Shard(np.arange(5000), np.arange(5000), v)
    read = []
    whole = s.scores
    s.scores = lambda rows, q: read.append(len(rows)) or whole(rows, q)
    got = s.top(-1, np.array([3, 0, 0, 0]), 5)
    assert [x for _, x in got] == [3 * x for x in (4999, 4998, 4997, 4996, 4995)] and sum(read) <= 64


def test_large_values_stay_exact():
    v = np.array([[2**40, 1], [2**40, 2], [-(2**40), 5]], np.int64)
    assert topk.Shard(np.array([1, 2, 3]), np.array([1, 2, 3]), v).top(0, np.array([2**20, 1]), 2) == [(2, 2**60 + 2), (1, 2**60 + 1)]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (None, [1.0, 1.0], 1), (7, [0.5, 0.5], 1)], SCHEMA)
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect()))
    twin, other = 256 * 256 + 128 * 128, 256 * 128 + 128 * 128
    assert got == [(0, 1, 0, twin), (0, 1, 0, twin), (0, 2, 7, other), (0, 2, 7, other)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_registered_query_against_its_sql_with_several_lengths_and_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i % 90, [rng.gauss(0, 1) for _ in range(rng.choice([3, 3, 5]))], 0) for i in range(120)] + [(100, [], 0), (150, [], 0), (200, None, 0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    got = queries.op10_exact_topk(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert oracle.ours(got) == oracle.twin(queries.oracle_sql()["op10_exact_topk"], str(tmp_path))
