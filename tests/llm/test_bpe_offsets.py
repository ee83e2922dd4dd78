import hashlib
import struct

import public_tokenizers as P

from quillspark.llm import bpe, queries

PATH = P.path(bpe.RANKS)


def test_tokenize_carries_the_piece_offsets(spark):
    texts = {1: "It's 42 Grüße,  日本 now", 2: "", 3: None, 4: "🙂 a"}
    by_piece, by_rank = bpe.ranks(PATH)
    got = {r.doc_id: r for r in bpe.tokenize(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect()}
    assert got[1].offsets[:3] == [0, 2, 4] and got[2].offsets == got[3].offsets == []
    for d, t in texts.items():
        t, at = t or "", got[d].offsets
        pieces = [t[a:b] for a, b in zip(at, [*at[1:], len(t)])]
        assert [i for x in pieces for i in bpe.merge(x.encode(), by_piece)] == got[d].ids
        assert "".join(pieces).encode() == bytes(got[d].decoded)


def test_pieces_decode_one_by_one_by_their_offsets():
    enc = bpe.encoder(PATH)
    for text in ("It's 42 Grüße,  日本 now", "🙂 a", "x" * 300):
        ((ids, starts, stops),) = enc.encode_with_offsets([text])
        assert enc.decode(ids, stops) == enc.decode(ids) == text.encode() and stops[-1] * 4 == len(ids)
        for a, b, i, j in zip(starts, [*starts[1:], len(text)], [0, *stops], stops):
            assert enc.decode(ids[4 * i : 4 * j]) == text[a:b].encode()


def test_registered_query_gives_digests_of_ids_bytes_and_offsets(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_byte_bpe(spark, sf)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    enc = bpe.encoder(PATH)
    for r in got.collect():
        ((ids, starts, _),) = enc.encode_with_offsets([docs[r.doc_id]])
        assert r.n_tokens * 4 == len(ids) and r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        assert r.n_pieces == len(starts) and r.offsets_sha256 == hashlib.sha256(struct.pack(f"<{len(starts)}I", *starts)).hexdigest()
