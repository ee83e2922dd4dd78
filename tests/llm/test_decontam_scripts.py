import pytest

from quillspark.llm import decontam

ITEMS = {1: "法国的首都是哪一座城市？请写出它的名字。", 2: "日本で一番高い山の名前は何ですか。", 3: "เมืองหลวงของประเทศไทยคือเมืองอะไร"}


@pytest.mark.parametrize("text, want", [("ab，cd ef", "ab cd ef"), ("«Été»—Ok", "Été ok"), ("山x山。", "山 x 山"), ("a　カナ", "a カ ナ"), ("한국 사람", "한국 사람")])
def test_tokens(text, want):
    assert [t.decode() for t in decontam.tokens(text.encode())] == want.split()


def test_leaks_in_unspaced_scripts(spark):
    docs = spark.createDataFrame([(i, f"前文。{t}后文") for i, t in ITEMS.items()] + [(9, "今天的天气很好，我们去公园里散步吧。")], "doc_id long, text string")
    bench = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.find(docs, bench, 20).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 9: []}
