import public_tokenizers

import corpus_pipeline
from quillspark.llm import bpe, decontam, toxicity
from tests.llm.test_pii import plain
from tests.llm.test_simhash import slow_groups
from tests.llm.test_verified_dedup import plain_stay


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~corpus_pipeline.held_out(4))
    rows = docs.collect()
    scores = model.score([r.text.encode() for r in rows])
    left = [r for r, s in zip(rows, scores) if s < toxicity.THRESHOLD]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in left}

    texts = {r.doc_id: r.text for r in left}
    stay = plain_stay(slow_groups(texts, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_BITS, corpus_pipeline.NEAR_TABLES), texts)
    one = stages["near_dedup"](spark, clean, sf)
    assert one.columns == docs.columns
    left = [r for r in left if r.doc_id in stay]
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in left}

    whole = stages["decontamination"](spark, one, sf)
    tokens = lambda t: " " + " ".join(w.decode() for w in decontam.tokens(t.encode())) + " "
    passages = [tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in left if any(p in tokens(r.text) for p in passages)}
    kept = {r.doc_id for r in whole.collect()}
    assert leaky and not kept & leaky and len(kept) >= len(left) - len(leaky) - 1

    masked = stages["pii"](spark, whole, sf)
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert not plain(r.text) and r.n_chars == len(r.text)

    last = stages["byte_bpe"](spark, masked, sf)
    text = {r.doc_id: r.text for r in masked.collect()}
    by_rank = bpe.ranks(public_tokenizers.path(bpe.RANKS))[1]
    for r in last.collect():
        assert bytes(r.decoded).decode() == text[r.doc_id] == b"".join(by_rank[i] for i in r.ids).decode()


def test_run_is_the_stages_in_a_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    want = {r.doc_id: r.ids for r in docs.collect()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == want and want
