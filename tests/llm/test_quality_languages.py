from quillspark.llm import quality


def test_every_language_has_its_own_bounds(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_TRUSTED", 1)
    name = lambda i: "".join(chr(97 + int(x)) for x in f"{i:04d}")
    rows = [(i, f"the {name(i)} and {name(7 * i)} of it", f"l{i // 3}") for i in range(3600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(3600)], "doc_id long, quality int")
    judged = {r.doc_id for r in docs.select("doc_id").where(quality._draw() >= 0.5 * quality._DRAW).collect()}
    own = {}
    got = quality.classify(docs, labels).collect()
    for r in got:
        if r.doc_id in judged:
            own.setdefault(r.doc_id // 3, []).append(r.perplexity)
    assert len(got) == 3600 and len(own) > 1000
    assert all((r.least, r.most) == (min(own[r.doc_id // 3]), max(own[r.doc_id // 3])) for r in got if r.doc_id // 3 in own)
