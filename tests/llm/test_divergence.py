"""Source divergence against a plain version and its SQL; tries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import divergence, queries
from tests.oracle import ours, twin

SCHEMA = "text string, lang string, source string, term string, p int, value string"


def plain(rows, least=30, top=50):
    lower = str.maketrans({chr(b): chr(b + 32) for b in range(65, 91)})
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, source in list(n):
        kept = [t for t, c in docs[lang].items() if c >= least]
        others = [s for x, s in n if x == lang]
        total = {t: sum(n[lang, s][t] for s in others) for t in kept}
        p, q = shares(n, lang, others, kept), whole(total)
        pairs = sorted((-sum(abs(p[source][t] - p[s][t]) for t in kept), s.encode(), s) for s in others if s != source)
        terms = sorted((q[t] - p[source][t], t.encode(), t) for t in kept if n[lang, source][t] and p[source][t] > q[t])[:top]
        for part, found in (("pair", pairs), ("term", terms)):
            out += [(lang, source, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def shares(n, lang, others, kept):
    size = {s: sum(n[lang, s][u] for u in kept) for s in others}
    return {s: {t: 1 + 10**9 * (n[lang, s][t] + 5) // (size[s] + 5 * len(kept)) for t in kept} for s in others}


def whole(total):
    size = sum(total.values())
    return {t: 1 + 10**9 * (c + 5) // (size + 5 * len(total)) for t, c in total.items()}


def run(spark, rows, **given):
    return sorted(map(tuple, divergence.audit(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3), **given).collect()))


def made(seed, n, sources=7):
    rng = random.Random(seed)
    bag = ["the", "The", "café", "日本語", "naïve", "zeta", "a", "ab", "abc", "abd", "x9y", "O'Neil", "ﬁ"]
    return [(" ".join(rng.choices(bag, weights=[9, 5, 4, 3, 1, 1, 9, 9, 9, 1, 1, 1, 1], k=rng.randrange(1, 20))), rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}") for _ in range(n)]


def test_against_the_plain_version(spark):
    rows = made(1, 300) + [(None, "en", "s1"), ("", "xx", "only"), ("", "xx", None), ("rare", "yy", "é"), ("1234 ?!", "en", "none"), ("w" * 100_000 + " the", "en", "s2")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, least_docs=3, top=2) == plain(rows, 3, 2)


def test_more_sources_than_a_block_and_terms_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "CHUNK", 3)
    monkeypatch.setattr(divergence, "MOST_LEAVES", 5)
    rows = made(2, 300, sources=30)
    assert run(spark, rows, least_docs=2) == plain(rows, 2)


def test_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_tries_walk_in_byte_order(seed):
    rng = random.Random(seed)
    trie, want = divergence.Trie(), Counter()
    for _ in range(500):
        term, group = bytes(rng.choice(b"ab\xc3\xa9z") for _ in range(rng.randrange(1, 7))), rng.randrange(3)
        trie.add(np.array([[trie[term], group, 2, 1]]))
        want[term, group] += 2
    assert [t for t, _ in trie.walk()] == sorted({t for t, _ in want})
    terms, rows, size = trie.leaves()
    own = [t for t, k in zip(terms, size) for _ in range(k)]
    assert [(t, r[0], r[1], r[2]) for t, r in zip(own, rows.tolist())] == [(t, g, n, n // 2) for (t, g), n in sorted(want.items())]


def test_query_against_its_sql(spark, sf):
    assert ours(queries.op13_source_divergence(spark, sf)) == twin(queries.oracle_sql()["op13_source_divergence"], sf)
