import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm import bpe

PATH = P.path(bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(texts):
    got = bpe.encoder(PATH).encode_with_offsets(texts)
    return [[t[a:b] for a, b in zip(at, [*at[1:], len(t)])] for t, (_, at, _) in zip(texts, got)]


def test_boundaries_equal_the_pattern():
    rng = random.Random(3)
    alphabets = ["a' st", "'stmdrevl \n", "ab1 .'\t\n ", "é中²½Ⅷ_ 　 'r", "   \n\na.", "'re've'll'd's't'm x"]
    texts = ["".join(rng.choice(alphabets[i % 6]) for _ in range(rng.randint(0, 40))) for i in range(20_000)]
    pattern = regex.compile(P.PATTERN)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert pieces(part) == [[m[0] for m in pattern.finditer(t)] for t in part]


def test_every_code_point_is_classed_as_the_library_does(library):
    texts = ["".join(f"a{chr(c)}a {chr(c)}1{chr(c)}" for c in range(at, min(at + 997, 0x110000)) if not 0xD800 <= c <= 0xDFFF) for at in range(0, 0x110000, 997)]
    ours = bpe.encoder(PATH).encode(texts)
    differ = sum(np.frombuffer(x, "<u4").tolist() != library.encode_ordinary(t) for t, x in zip(texts, ours))
    assert differ == 0


def test_ids_and_round_trip_on_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.digests(docs, PATH).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_long_pieces(library):
    rng = random.Random(1)
    for t in ["a" * 5000, "".join(rng.choice("abcdeth") for _ in range(3000)), "é" * 700, " " * 900 + "x", "=" * 1234]:
        ours = bpe.encoder(PATH).encode([t])[0]
        assert np.frombuffer(ours, "<u4").tolist() == library.encode_ordinary(t)
        assert bpe.encoder(PATH).decode(ours) == t.encode()


def test_edges_of_the_domain(spark):
    long = "some words 123 " * 60_000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, "It's", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("ids", F.lit(1))
    got = bpe.tokenize(docs, PATH).collect()
    assert [len(r.ids) for r in got[:2]] == [0, 0] and got[0].decoded == b""
    assert got[2].ids == got[3].ids and bytes(got[2].decoded) == long.encode()
    assert got[4].doc_id is None and bytes(got[4].decoded) == b"It's"
    assert bpe.digests(docs.limit(0), PATH).collect() == []
