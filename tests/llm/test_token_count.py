import random

import public_tokenizers as P
from pyspark.sql import functions as F

from quillspark.llm import token_count
from quillspark.llm.bpe import RANKS, ranks

PATH = P.path(RANKS)


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in vocabulary:
                break
        else:
            return 1
        n, at = n + 1, end
    return n


def test_random_vocabularies_with_unknowns():
    rng = random.Random(4)
    for _ in range(300):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))}
        automaton = token_count.LongestMatch(vocabulary)
        for _ in range(60):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(0, 14)))
            assert automaton.count(word) == greedy(word, vocabulary, 6), (word, vocabulary)


def test_documents_against_greedy_matching(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocabulary = ranks(PATH)[0]
    longest, seen = max(map(len, vocabulary)), {}
    for r in token_count.token_counts(docs, PATH).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = r.text.encode().split()
        for w in words:
            if w not in seen:
                seen[w] = greedy(b" " + w, vocabulary, longest)
        assert (r.n_words, r.n_tokens) == (len(words), sum(seen[w] for w in words))


def test_edges_of_the_domain(spark):
    long = "x" * 300_000
    rows = [(1, None, "x"), (2, " \n", "x"), (3, long, "x"), (3, long, "x"), (None, "It is", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_tokens", F.lit("x"))
    got = token_count.token_counts(docs, PATH).collect()
    assert [r.n_words for r in got] == [0, 0, 1, 1, 2] and [r.n_tokens for r in got[:2]] == [0, 0]
    assert got[2].n_tokens == got[3].n_tokens == greedy(b" " + long.encode(), ranks(PATH)[0], 128)
    assert got[4].doc_id is None
    assert token_count.token_counts(docs.limit(0), PATH).collect() == []
