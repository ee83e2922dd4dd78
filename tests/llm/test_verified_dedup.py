import random

import numpy as np

import corpus_pipeline
from quillspark.llm import simhash
from tests.llm.test_simhash import slow_groups

SCHEMA = "doc_id long, text string, lang string"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_stay(groups, texts):
    """By id, each document stays that is under 0.8 to all that stay of its group."""
    kept = {}
    for d in sorted(groups):
        x, own = plain_set(texts[d]), kept.setdefault(groups[d], {})
        if not any(5 * len(x & y) >= 4 * len(x | y) for y in own.values()):
            own[d] = x
    return {d for own in kept.values() for d in own}


def test_near_dedup_removes_only_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = slow_groups(texts, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_BITS, corpus_pipeline.NEAR_TABLES)
    want = plain_stay(groups, texts)
    assert len(set(groups.values())) < len(want) < len(texts)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_a_large_group_takes_several_rounds(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(words)
    want = plain_stay(dict.fromkeys(texts, 0), texts)
    assert 20 < len(want) < 120
    members = spark.createDataFrame([(0, d, 7, t) for d, t in texts.items()], "c long, doc_id long, h long, text string")
    for heads, shingles in ((40, 1 << 22), (512, 5000), (512, 1 << 22)):
        monkeypatch.setattr(simhash, "HEADS", heads)
        monkeypatch.setattr(simhash, "HEAD_SHINGLES", shingles)
        got = [(r.doc_id, r.h) for r in simhash.unlike(members, 0.8, part_rows=50).collect()]
        assert sorted(got) == sorted((d, 7) for d in want)


def test_edges_of_the_domain(spark):
    long = "word " * 50_000
    rows = [(1, None, "x"), (2, "", None), (3, long, "x"), (3, long, "x"), (None, "lone text here now", None), (None, long, None), (7, "A b", "x"), (8, "a B", "x"), (9, "c d", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_unlike(docs, 0.8)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 7, 9, None, None], key=str)
    assert simhash.keep_unlike(docs.limit(0), 0.8).collect() == []


def similar_pairs(sets, least):
    """All pairs of sets of at least this Jaccard similarity, through an inverted index."""
    sizes = np.array([len(x) for x in sets])
    keys, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, own, found = keys[order], own[order], []
    for i, x in enumerate(sets):
        at = np.concatenate([own[a:b] for a, b in zip(np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")) if b - a > 1] or [[]]).astype(int)
        common = np.bincount(at, minlength=len(sets))
        found += [(i, int(k)) for k in np.flatnonzero(common >= least * (sizes + len(x) - common)) if k > i and common[k]]
    return found


def test_candidates_reach_nine_in_ten_of_all_similar_pairs(spark):
    """Over all pairs of different texts: whole table of 10,000 documents, and copies of it with words replaced."""
    texts = sorted({r.text.lower() for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text})
    rng = random.Random(8)
    for t in rng.sample([t for t in texts if 40 <= len(t.split()) <= 600], 400):
        words = t.split()
        for _ in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.02])))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    pairs = similar_pairs([simhash.shingle_set(t.encode(), 5) for t in texts], corpus_pipeline.SIMILAR)
    fps = {i: simhash.table_fingerprints(texts[i].encode(), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_TABLES) for p in pairs for i in p}
    hit = [any((x ^ y).bit_count() <= corpus_pipeline.NEAR_BITS for x, y in zip(fps[a], fps[b])) for a, b in pairs]
    assert len(pairs) > 300 and sum(hit) >= 0.95 * len(hit)
