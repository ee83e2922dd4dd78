import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash

SCHEMA = "doc_id long, text string, lang string"


def slow_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles))


def slow_components(fps, radius):
    left, out = set(fps), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        for x in group:
            out[x] = frozenset(group)
    return out


def slow_groups(texts, width, radius, tables):
    """The smallest id of each document's group, where any table may link."""
    fps = {d: simhash.table_fingerprints((t or "").encode(), width, tables) for d, t in texts.items()}
    up = {d: d for d in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sorted(fps)):
        for b in sorted(fps)[:i]:
            if any((x ^ y).bit_count() <= radius for x, y in zip(fps[a], fps[b])):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in fps}


def test_fingerprint_matches_plain_definition():
    for t in ["", " \t", "A", "a B", "the Cat sat ON the mat", "ÀÉ à x\x0by\x1cz\x85w v", "x " * 999]:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_spark_hash_is_the_same_hash(spark):
    got = spark.createDataFrame([("the cat sat",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("the cat sat".encode(), 42)


@pytest.mark.parametrize("radius", [1, 2, 4])
@pytest.mark.parametrize("tree_rows", [4096, 7])
def test_links_give_the_brute_force_components(spark, radius, tree_rows):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds[:4]:
        for _ in range(40):
            x = rng.choice(sorted(fps)) if rng.random() < 0.3 else s
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    want = slow_components(fps, radius)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges = simhash.link_edges(df, radius, tree_rows)
    assert all(((a ^ b) & simhash._ALL).bit_count() >= 1 for a, b in edges.collect())
    got = {a % 2**64: b % 2**64 for a, b in simhash.components(edges).collect()}
    assert {x: min(map(simhash._signed, want[x])) % 2**64 for x in fps} == {x: got.get(x, x) for x in fps}


def test_near_duplicates_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    groups = slow_components(set(fps.values()), 2)
    least = {}
    for d, f in fps.items():
        least[groups[f]] = min(least.get(groups[f], d), d)
    want = {d: (f"{f:016x}", least[groups[f]]) for d, f in fps.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("tables", [2, 4])
def test_any_table_links(spark, sf, tables):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow_groups({r.doc_id: r.text for r in docs.collect()}, 3, 4, tables)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, radius=4, tables=tables).collect()}
    assert got == want


def test_edges_of_the_domain(spark):
    long = "word " * 50_000
    rows = [(1, None, "x"), (2, "", None), (3, long, "x"), (3, long, "x"), (None, "lone text here now", None), (None, long, None), (7, "A b", "x"), (8, "a B", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fingerprint", F.lit(1)).withColumn("component_id", F.lit(9)).withColumn("fp", F.lit(0))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, None), (None, 3), (7, 7), (8, 7)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 7, None, None], key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []
