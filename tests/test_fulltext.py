"""The MATCH grammar, phrases over places, and snippets as columns."""

import random
import shutil
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions.latin import tokens
from quillspark.operators import fulltext, rank
from quillspark.operators.fulltext import Both, Either, MatchError, Near, Without, parse
from quillspark.operators.rank import Phrase
from quillspark.plans import catalog

NOTES = [
    ("a.md", "d", "One two", "x", None, "the quick brown fox jumps over the lazy dog"),
    ("b.md", "d", "Brown", "fox tail", "", "fox. fox, the quick? quick-brown; École"),
    ("c.md", "e", None, None, None, None),
    ("d.md", "e", "quick", "", "brown fox", "a b c d e f g h i j k l m n o p the fox"),
    *((f"{i}.md", "f", "filler", "", "", "nothing here") for i in range(9)),
]


@pytest.fixture(scope="module")
def index(spark):
    notes = spark.createDataFrame(NOTES, "rel_path string, domain string, title string, tags string, summary string, body string").cache()
    counted = rank.postings(notes).cache()
    return {"notes": notes, "postings": counted, "lengths": rank.lengths(notes, counted)}


def found(index, text, domain=None):
    return {r.rel_path[0] for r in fulltext.match(index, text, domain).collect()}


def test_grammar():
    p = lambda *t, **k: Phrase(t, **k)
    assert parse("a b NOT c AND d OR e") == Either((Both((Without(Both((p("a"), p("b"))), p("c")), p("d"))), p("e")))
    assert parse('"One  Two" + three*') == p("one", "two", "three", prefix=True)
    assert parse("^a") == p("a", first=True) and parse("snake_case") == p("snake", "case") and parse("École") == p("ecole")
    assert parse("title:a") == p("a", columns=("title",)) and parse("- {title body} : a") == p("a", columns=("domain", "tags", "summary"))
    assert parse("{title tags} : (a OR title : b)") == Either((p("a", columns=("title", "tags")), p("b", columns=("title",))))
    assert parse("NEAR(a b)") == Near((p("a"), p("b"))) and parse("NEAR(a b c*, 3)").distance == 3 and parse("near") == p("near")
    assert parse("  ") is None
    for bad in ("(a", "a)", "AND a", "a AND", "a OR", "NEAR(a, b)", "colour : a", "-a", "a ; b", "{title : a", "*", '"a'):
        with pytest.raises(MatchError):
            parse(bad)


def test_notes_that_match(index):
    assert found(index, "quick brown") == {"a", "b", "d"} and found(index, '"quick brown"') == {"a", "b"} and found(index, '"brown quick"') == set()
    assert found(index, "quick + bro*") == {"a", "b"} and found(index, "ecole") == {"b"} and found(index, "zzz OR lazy") == {"a"}
    assert found(index, "fox NOT (tags : fox)") == {"a", "d"} and found(index, "title : quick OR summary : brown") == {"d"} and found(index, "body : ^fox") == {"b"}
    assert found(index, "NEAR(quick fox, 0)") == set() and found(index, "NEAR(quick fox, 1)") == {"a", "b"} and found(index, "NEAR(the dog jumps, 3)") == {"a"}
    assert found(index, "NEAR(the dog jumps, 2)") == set() and found(index, "fox", "e") == {"d"} and found(index, '""') == set() and found(index, "") == set()
    assert found(index, "one two") == {"a"} and found(index, '"two the"') == set()  # phrases don't cross columns


def test_scores_follow_columns_and_nears_count_their_clumps(index):
    score = lambda text: {r.rel_path[0]: r.score for r in fulltext.match(index, text).collect()}
    assert score("quick")["d"] > score("quick")["a"] and score("domain : d") == {"a": 0.0, "b": 0.0}
    words = {r.rel_path[0]: r.score for r in rank.bm25(index, "lazy").collect()}
    assert words["a"] == pytest.approx(score("lazy")["a"], abs=0.002)
    assert score("NEAR(the lazy, 0)")["a"] < score("the lazy")["a"]  # the first "the" stands outside


def test_index_holds_places_not_texts(index):
    rows = {(r.term, r.rel_path): r for r in index["postings"].collect()}
    assert rows["fox", "b.md"].places == [[], [], [0], [], [0, 1]] and rows["fox", "b.md"].tf == [0, 0, 1, 0, 2]
    assert {r.rel_path: r.n_tokens for r in index["lengths"].where("domain <> 'f'").collect()} == {"a.md": 13, "b.md": 11, "c.md": 1, "d.md": 22}


def test_snippets(spark, index):
    def shown(body, marks, words=12):
        df = spark.createDataFrame([(body, marks)], "body string, marks array<struct<p:int,s:int,e:int>>")
        return df.select(rank.snippet(F.col("body"), F.col("marks"), words)).first()[0]

    assert shown("one two three", [(0, 1, 2)]) == "one **two** three" and shown("", []) == "" and shown("...", []) == ""
    assert shown("a b c d e", [(0, 1, 3), (1, 2, 4)]) == "a **b c d** e" and shown("a b c", [(0, 0, 1), (1, 1, 2)]) == "**a** **b** c"
    assert shown("a b c d e f", [(0, 3, 4), (1, 4, 5)], 3) == "...c **d** **e**..." and shown("(a) - b!", [], 2) == "a) - b"
    assert shown("a b c d", [(0, 1, 4)], 3) == "a **b c**..."
    hits = fulltext.match(index, "the + quick OR fox")
    got = {r.rel_path[0]: r.snippet for r in fulltext.with_snippets(index, index["notes"], hits, "the + quick OR fox").collect()}
    assert got["a"] == "**the quick** brown **fox** jumps over the lazy dog" and got["d"] == "...f g h i j k l m n o p the..." or got["d"].endswith("the **fox**")
    assert got["b"] == "**fox**. **fox**, **the quick**? quick-brown; École"


QUERIES = ["quick + bro*", "fox NOT (tags : fox)", "the OR NEAR(the fox, 20)"]


@pytest.mark.parametrize("text", QUERIES)
def test_notes_alone_give_what_their_index_gives(index, text):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    alone = {"notes": index["notes"]}
    assert rows(fulltext.match(alone, text)) == rows(fulltext.match(index, text)) and rows(rank.bm25(alone, text)) == rows(rank.bm25(index, text))
    shown = [fulltext.with_snippets(x, index["notes"], fulltext.match(x, text, bodies=b), text) for x, b in ((index, False), (index, True), (alone, False), (alone, True))]
    assert len({tuple(rows(x)) for x in shown}) == 1 and shown[0].columns == shown[3].columns


def test_a_query_of_notes_moves_no_texts(spark, index):
    d = "/root/testdata/sf0.001"
    for name in ("match_first", "bm25_phrase", "match_snippet"):
        plan = catalog.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan, name


def plain_clumps(places, reach):
    heads = [[f for f in s if all(any(f <= x <= f + r for x in t) for t in places)] for s, r in zip(places, reach)]
    return [[x for x in s if any(g <= x <= g + r for h, r in zip(heads, reach) for g in h)] for s in places]


def test_clumps_against_every_pair_and_of_a_long_note(spark):
    rng = random.Random(3)
    rows = [[[sorted(rng.sample(range(30), rng.randint(0, 8))) for _ in rank.WEIGHTS] for _ in range(3)] for _ in range(60)]
    arrays = [pa.array([r[j] for r in rows], pa.list_(pa.list_(pa.int32()))) for j in range(3)]
    for reach in ([1, 2, 1], [5, 6, 5], [40, 40, 40], [1 << 40] * 3):
        got = fulltext._inside(reach)(*(a.slice(5) for a in arrays))
        for n, r in enumerate(rows[5:]):
            want = [plain_clumps([r[j][c] for j in range(3)], reach) for c in range(len(rank.WEIGHTS))]
            assert [got[n].as_py()[f"p{j}"] for j in range(3)] == [[w[j] for w in want] for j in range(3)]
    long = {"notes": spark.createDataFrame([("a.md", "d", "", "", "", "the word of the world " * 40_000)], "rel_path string, domain string, title string, tags string, summary string, body string")}
    began = time.monotonic()
    assert [r.rel_path for r in fulltext.match(long, 'NEAR(the "of the" wor*, 4)').collect()] == ["a.md"]
    assert time.monotonic() - began < 60


def shuffled(spark):
    """Bytes that the session's stages wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["bm25_stemming", "match_first", "bm25_phrase", "match_snippet", "match_phrase", "match_columns", "rrf_hybrid"])
def test_a_search_of_a_table_shuffles_a_small_part_of_its_text(spark, name):
    d = "/root/testdata/sf0.01"
    text = spark.read.parquet(f"{d}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    assert catalog.queries()[name](spark, d).collect()
    assert shuffled(spark) - before < text / 50


@pytest.mark.parametrize("name", ["match_first", "bm25_phrase", "match_snippet", "match_phrase", "match_columns", "rrf_hybrid"])
def test_the_first_search_of_a_table_shuffles_a_small_part_of_its_text(spark, tmp_path, name):
    for t in ("documents", "embeddings"):  # a path of its own, so that nothing kept by an earlier search serves it
        shutil.copy(f"/root/testdata/sf0.01/{t}.parquet", tmp_path)
    text = spark.read.parquet(f"{tmp_path}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    assert catalog.queries()[name](spark, str(tmp_path)).collect()
    assert shuffled(spark) - before < text / 50


def test_a_prefix_spares_the_tests_of_what_begins_with_it(spark):
    phrases = list(dict.fromkeys(p for g in rank.parse("working worked") for p in g))
    slots = rank._slots(phrases, False)[0]
    assert len(slots) == 6 and rank._widest(slots) == [("work", True)]
    assert rank._widest([("a", False), ("ab", True), ("abc", False), ("ab", False)]) == [("a", False), ("ab", True)]
    text = "Working works WORK worker W\u00f6rking word worked working"
    notes = spark.createDataFrame([("a.md", "d", "", "", "", text)], "rel_path string, domain string, title string, tags string, summary string, body string")
    row, words = rank.scanned(notes, phrases, False, ["rel_path"]).first(), rank.plain_tokens(text)
    for i, p in enumerate(phrases):
        assert row[f"o{i}"][4] == sum(w.startswith(p.tokens[0]) if p.prefix else w == p.tokens[0] for w in words), p


def test_ascii_texts_are_not_looked_up_letter_by_letter(spark):
    texts = ["Plain TEXT, 2 words", "\u00c9cole f\u00fcr", "na\u00efve plain \u00c5NGSTR\u00d6M \u4e2d\u6587", "", None]
    split = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens("t").alias("words"))
    assert [tuple(r.words) for r in split.collect()] == [rank.plain_tokens(t or "") for t in texts]
    assert "octet_length" in split._jdf.queryExecution().optimizedPlan().toString()
