"""Very long and repetitive texts: bounded memory, same rows."""

import random
import subprocess
import sys


from quillspark.llm import decontam
from quillspark.llm.common import Memo
from tests.llm.test_decontam import brute


def test_pieces_give_the_same_items(monkeypatch):
    rng = random.Random(7)
    words = ["a", "b", "c"]
    items = [(i, " ".join(rng.choices(words, weights=[9, 1, 1], k=rng.choice([6, 13, 20, 40])))) for i in range(12)] + [(12, "a " * 40)]
    texts = ["a " * 200, "b a " * 90, "", *(" ".join(rng.choices(words, weights=[6, 1, 1], k=rng.choice([3, 30, 120]))) for _ in range(30))]
    block = decontam.Block([(i, t.encode()) for i, t in items])
    memo = Memo(decontam.xxhash.xxh64_intdigest)
    for size in (1, 50, 1 << 18):
        monkeypatch.setattr(decontam, "PIECE_HITS", size)
        got = decontam._scan([block], [t.encode() for t in texts], memo)
        assert [set(ids) for _, ids in got] == [brute(t, items) for t in texts]


def test_a_million_equal_words_in_bounded_memory():
    """In a process of its own, for its peak of memory."""
    code = """
import resource
from quillspark.llm import decontam
from quillspark.llm.common import Memo
block = decontam.Block([(1, b"word " * 300), (2, b"word " * 11 + b"x y " * 100)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = decontam._scan([block], [b"word " * 1_000_000], Memo(decontam.xxhash.xxh64_intdigest))
assert got == [(True, [1, 2])], got
grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
assert grown < 500, grown
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
