"""Repeated passages against brute force: transform, places, hot keys, odd texts."""

import hashlib
import random
from collections import Counter

import pytest

from quillspark.llm import bwt, queries, repeats


def plain(texts: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    return [repeats.merged([(i, i + 1) for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1], window) for t in texts]


def check(spark, texts, window, anchor, most):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, key string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove(df, window, anchor, most).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, want) in enumerate(zip(raw, plain(raw, window))):
        assert [(s.start, s.stop) for s in got[i].spans] == want, i
        gone = {j for a, b in want for j in range(a, b)}
        assert bytes(got[i].kept) == bytes(x for j, x in enumerate(t) if j not in gone) and got[i].n_bytes == len(t)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def test_transform_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        window, size = rng.choice([2, 3, 8, 20]), rng.choice([1, 2, 4, 256])
        texts = [bytes(rng.randrange(size) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 7))]
        texts += [texts[0][2:] + texts[-1], texts[0]] if rng.random() < 0.5 else []
        seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
        assert [x.tolist() for x in bwt.repeated(texts, window)] == [[i + window <= len(t) and seen[t[i : i + window]] > 1 for i in range(len(t))] for t in texts]
    assert bwt.repeated([], 5) == []


@pytest.mark.parametrize("most", [2, 1024])
def test_passages_copies_and_edges(spark, most):
    rng = random.Random(3)
    passage, line = words(rng, 60), words(rng, 12)
    texts = [None, "", "short", "a" * 300, "é" * 101, "ab" * 150, words(rng, 80)]
    texts += [words(rng, 30) + passage[i : i + 90 + 7 * i] + words(rng, 20) for i in range(12)]
    texts += [words(rng, 20) + line + words(rng, 20) for _ in range(12)]
    texts += [texts[6]] * 4 + [texts[6][:150] + "X" + texts[6][151:]] + [passage + words(rng, 9) + passage]
    check(spark, texts, 50, 16, most)


def test_hot_line_one_byte_short_of_the_window(spark):
    """A line of all documents that is one byte too short, with either neighbour byte shared by some: no task gets the whole key."""
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(49))
    texts = [words(rng, 12) + rng.choice("<(") + line + rng.choice(">)!") + words(rng, 12) for _ in range(60)]
    check(spark, texts, 50, 16, 5)
    texts = [f"{i:04d}{line}{i:04d}" for i in range(40)]
    check(spark, texts, 50, 16, 5)


def test_very_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    long = words(rng, 300)
    monkeypatch.setattr(repeats, "PIECE", 256)
    for texts in ([long, long[400:700], long[:120] + long[:120]], ["x" * 2000, "y" + "x" * 60]):
        number, at, n, *_ = repeats.places_of([t.encode() for t in texts], 50, 16)
        had = sorted((t, w) for t, a, k in zip(number.tolist(), at.tolist(), n.tolist()) for w in range(a, a + k))
        assert had == [(t, w) for t, text in enumerate(texts) for w in range(len(text) - 49)]  # each window in one place
    monkeypatch.undo()
    check(spark, ["the " * 300_000, long], 200, 64, 1024)


def test_halving_ends_with_whole_windows():
    text = bytes(range(256)) * 2
    now, rounds = [(0, 0, 137, 136, 200)], 0
    while any(cr - cl < 200 for *_, cl, cr in now):
        now = [(0, a + first, k, cl, cr) for _, a, n, l, r in now for _, first, k, cl, cr in repeats.halves(text[a : a + n + 199], n, l, r, 200)]
        rounds += 1
    assert rounds <= 8 and sorted(a for _, a, *_ in now) == list(range(137)) and all(n == 1 for _, _, n, *_ in now)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.digests(df).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and repeats.digests(df).count() == 0


def test_query_on_the_smallest_table(spark, sf):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    want = dict(zip(ids, plain([texts[i] for i in ids], 200)))
    rows = queries.op12_suffix_dedup(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == ids
    for r in rows:
        gone = {j for a, b in want[r.doc_id] for j in range(a, b)}
        kept = bytes(x for j, x in enumerate(texts[r.doc_id]) if j not in gone)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(texts[r.doc_id]), len(gone), len(want[r.doc_id]), hashlib.sha256(kept).hexdigest())
