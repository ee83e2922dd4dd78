import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontam

DOC = "doc_id long, text string, lang string"
ITEM = "item_id long, text string"


def brute(text, items):
    """Ids of the items of which some window stands in the text with few substitutions, by trying every place."""
    t, out = decontam.tokens((text or "").encode()), set()
    for item_id, item in items:
        w = decontam.tokens((item or "").encode())
        if len(w) < decontam.SHORTEST:
            if w and w == t:
                out.add(item_id)
            continue
        n = min(decontam.WINDOW, len(w))
        for o in range(len(w) - n + 1):
            for p in range(len(t) - n + 1):
                if sum(a != b for a, b in zip(w[o : o + n], t[p : p + n])) <= int(0.2 * n):
                    out.add(item_id)
    return out


@pytest.mark.parametrize("block_tokens", [500_000, 40])
def test_same_as_brute_force(spark, block_tokens):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 7, 12, 13, 14, 20, 30])))) for i in range(25)]
    items += [(25, items[7][1].upper()), (26, items[8][1]), (27, None), (28, "")]
    docs = []
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            w = items[rng.randrange(25)][1].split()
            cut = w[rng.randint(0, 3) : len(w) - rng.randint(0, 3)]
            for _ in range(rng.randint(0, 4)):
                if cut:
                    cut[rng.randrange(len(cut))] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = cut
        docs.append((d, ", ".join(words), "x"))
    docs += [(150 + i, f" {t.upper()}! ", "x") for i, t in items if t and len(t.split()) == 3]
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = {r.doc_id: (r.contaminated, r.item_ids, r.n_items) for r in decontam.find(df, bench, block_tokens).collect()}
    want = {d: sorted(brute(t, items)) for d, t, _ in docs}
    assert 20 < sum(map(bool, want.values())) < 140
    assert got == {d: (bool(w), w, len(w)) for d, w in want.items()}
    assert {r.doc_id for r in decontam.keep_clean(df, bench, block_tokens).collect()} == {d for d, w in want.items() if not w}


def test_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: set(r.item_ids) for r in decontam.find(docs, bench).where("contaminated").collect()}
    items = [(r.item_id, " ".join(w.decode() for w in decontam.tokens(r.text.encode()))) for r in bench.collect()]
    exact = {}
    for r in docs.collect():
        text = " " + " ".join(w.decode() for w in decontam.tokens(r.text.encode())) + " "
        whole = {i for i, t in items if f" {t} " in text}
        if whole:
            exact[r.doc_id] = whole
    assert exact and all(w <= got[d] for d, w in exact.items())


def test_edges_of_the_domain(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = "filler " * 60_000 + passage
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, passage.upper(), None), (4, "one two", "x"), (5, passage.replace("three", "3"), "x")]
    docs = spark.createDataFrame(rows, DOC).withColumn("item_ids", F.lit("x")).withColumn("contaminated", F.lit("x"))
    bench = spark.createDataFrame([(7, passage), (7, passage), (None, passage), (8, "one two"), (9, None)], ITEM).withColumn("doc_id", F.lit(1))
    got = [(r.doc_id, r.contaminated, r.item_ids) for r in decontam.find(docs, bench).collect()]
    assert got == [(1, False, []), (2, False, []), (3, True, [7]), (3, True, [7]), (None, True, [7]), (4, True, [8]), (5, True, [7])]
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 2]
    assert decontam.find(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontam.find(docs, bench.limit(0)).collect())
    assert decontam.keep_clean(docs, bench.limit(0)).count() == 7


def test_several_blocks_a_pass_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_BLOCKS", 2)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(n))) for i, n in enumerate([14, 2, 20, 1, 13, 30])]
    docs = [(i, t, "x") for i, t in items] + [(6, items[0][1] + " and " + items[5][1], "x"), (7, "t1x0 t1x1 more", "x")]
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = {r.doc_id: r.item_ids for r in decontam.find(df, bench, 15).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [3], 4: [4], 5: [5], 6: [0, 5], 7: []}
    assert [r.doc_id for r in decontam.keep_clean(df, bench, 15).collect()] == [7]
