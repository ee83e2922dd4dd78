"""Full-text expressions over the positional index: the MATCH grammar of SQLite's full-text search, as one plan over postings.

    word   "some words"   pre*   one + two   ^first   title : word   {title body} : (..)   - body : word   NEAR(a "b c", 5)
    a b (both)   a AND b   a OR b   a NOT b   ( .. )

Words side by side bind closest, then NOT, AND, OR. An expression reads the postings of its tokens in one scan, gathers them
by note (or takes them from the notes) and decides each note by its places.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.latin import domain_is
from quillspark.operators import rank
from quillspark.operators.rank import WEIGHTS, Phrase, plain_tokens


class MatchError(ValueError):
    """The expression isn't one of the grammar."""


@dataclass(frozen=True)
class Near:
    """All phrases within so many tokens between the end of the first and the beginning of the last."""

    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Both:
    items: tuple


@dataclass(frozen=True)
class Either:
    items: tuple


@dataclass(frozen=True)
class Without:
    wanted: object
    unwanted: object


_TOKEN = re.compile(r'"(?:[^"]|"")*"|[\w\x80-\U0010ffff]+|[(){}:^*+,-]')


def parse(text: str):
    """The expression of a text; None if it has no words."""
    found, at = [], 0
    for m in _TOKEN.finditer(text):
        if text[at : m.start()].strip():
            raise MatchError(f"unexpected {text[at : m.start()].strip()[0]!r}")
        found.append(m[0])
        at = m.end()
    if text[at:].strip():
        raise MatchError(f"unexpected {text[at:].strip()[0]!r}")
    return _Reader(found).whole() if found else None


class _Reader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self, n: int = 0) -> str:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        now = self.peek()
        if not now or wanted and now != wanted:
            raise MatchError(f"expected {wanted or 'more'}, found {now or 'the end'}")
        self.at += 1
        return now

    def whole(self):
        out = self.chain("OR", Either, lambda: self.chain("AND", Both, self.without))
        if self.peek():
            raise MatchError(f"unexpected {self.peek()}")
        return out

    def chain(self, word: str, kind, part):
        items = [part()]
        while self.peek() == word:
            self.take()
            items.append(part())
        return items[0] if len(items) == 1 else kind(tuple(items))

    def without(self):
        out = self.side_by_side()
        while self.peek() == "NOT":
            self.take()
            out = Without(out, self.side_by_side())
        return out

    def side_by_side(self):
        items = [self.one()]
        while self.peek() not in ("", "AND", "OR", "NOT", ")"):
            items.append(self.one())
        return items[0] if len(items) == 1 else Both(tuple(items))

    def one(self):
        columns = self.columns()
        if self.peek() == "(":
            self.take()
            inner = self.chain("OR", Either, lambda: self.chain("AND", Both, self.without))
            self.take(")")
        elif self.peek() == "NEAR" and self.peek(1) == "(":
            self.at += 2
            phrases, distance = [], 10
            while self.peek() not in (")", ","):
                phrases.append(self.phrase())
            if self.peek() == ",":
                self.take()
                if not (n := self.take()).isdigit():
                    raise MatchError(f"{n} is no distance")
                distance = int(n)
            self.take(")")
            inner = Near(tuple(phrases), distance)
        else:
            inner = self.phrase()
        return inner if columns is None else _within(inner, columns)

    def columns(self) -> tuple[str, ...] | None:
        start = self.at
        other = self.peek() == "-"
        self.at += other
        if self.peek() == "{":
            self.take()
            names = []
            while self.peek() != "}":
                names.append(self.take())
            self.take()
        elif self.peek(1) == ":":
            names = [self.take()]
        else:
            if other:
                raise MatchError("- stands before columns only")
            self.at = start
            return None
        self.take(":")
        names = [n.strip('"').lower() for n in names]
        if wrong := [n for n in names if n not in WEIGHTS]:
            raise MatchError(f"no column {wrong[0]}")
        return tuple(c for c in WEIGHTS if (c in names) != other)

    def phrase(self) -> Phrase:
        first = self.peek() == "^"
        self.at += first
        words = self.words()
        while self.peek() == "+":
            self.take()
            words += self.words()
        prefix = self.peek() == "*"
        self.at += prefix
        return Phrase(words, prefix, None, first)

    def words(self) -> tuple[str, ...]:
        word = self.take()
        if word in ("AND", "OR", "NOT") or not (word[0] == '"' or re.match(r"[\w\x80-\U0010ffff]", word)):
            raise MatchError(f"unexpected {word}")
        return plain_tokens(" ".join(re.findall(r"[^\W_]+", word)))


def _within(node, columns: tuple[str, ...]):
    """The expression, in those columns only; inner columns count within outer ones."""
    if isinstance(node, Phrase):
        return replace(node, columns=columns if node.columns is None else tuple(c for c in node.columns if c in columns))
    if isinstance(node, Near):
        return replace(node, phrases=tuple(_within(p, columns) for p in node.phrases))
    if isinstance(node, Without):
        return Without(_within(node.wanted, columns), _within(node.unwanted, columns))
    return type(node)(tuple(_within(x, columns) for x in node.items))


def phrases_of(node, wanted_only: bool = False) -> list[Phrase]:
    """The phrases of an expression; those that must not stand may be left out."""
    if isinstance(node, Phrase):
        return [node] if node.tokens else []
    if isinstance(node, Near):
        return [p for p in node.phrases if p.tokens]
    if isinstance(node, Without):
        return phrases_of(node.wanted, wanted_only) + ([] if wanted_only else phrases_of(node.unwanted))
    return [p for x in node.items for p in phrases_of(x, wanted_only)]


def _inside(reach: list[int]) -> Callable:
    """A function of each phrase's places by column: those that belong to a clump. A clump begins where a phrase stands that all of
    them follow within its reach, and holds what stands within it; places are sorted, so each is found by bisection, for a batch of notes at once."""
    most = [min(r, 1 << 31) for r in reach]

    def run(*places: pa.Array) -> pa.Array:
        cells = [p.flatten() for p in places]
        keys = [np.repeat(np.arange(len(x), dtype=np.int64) << 40, x.value_lengths().to_numpy()) + x.flatten().to_numpy() for x in cells]
        heads = [own[reduce(np.logical_and, (_follows(own, k, r) for k in keys))] for own, r in zip(keys, most)]
        kept = [own[reduce(np.logical_or, (_follows(-own, -h[::-1], r) for h, r in zip(heads, most)))] for own in keys]
        return pa.StructArray.from_arrays([_by_cell(k, len(x), p) for k, x, p in zip(kept, cells, places)], [f"p{i}" for i in range(len(kept))])

    return run


def _follows(starts: np.ndarray, keys: np.ndarray, reach: int) -> np.ndarray:
    """Whether one of the sorted keys lies at each start or at most so far behind it."""
    at = np.searchsorted(keys, starts)
    return np.append(keys, np.iinfo(np.int64).max)[at] <= starts + reach


def _by_cell(keys: np.ndarray, cells: int, like: pa.Array) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(keys >> 40, minlength=cells))]).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(ends), pa.array((keys & ((1 << 40) - 1)).astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(like.value_lengths().to_numpy())]).astype(np.int32)), inner)


def _nears(node) -> list[Near]:
    """The NEARs that can be met."""
    return list(dict.fromkeys(near for _, near in _leaves(node) if near and all(p.tokens for p in near.phrases)))


def _clumped(found: DataFrame, nears: list[Near], number: dict) -> DataFrame:
    """With the places of each NEAR's phrases within its clumps, as near0, near1, .."""
    kept = {}
    for n, near in enumerate(nears):
        kind = "struct<{}>".format(",".join(f"p{i}:array<array<int>>" for i in range(len(near.phrases))))
        inside = F.arrow_udf(_inside([len(p.tokens) + near.distance for p in near.phrases]), kind)
        kept[f"near{n}"] = inside(*(F.col(f"o{number[p, near]}") for p in near.phrases))
    return found.withColumns(kept) if kept else found


def _decide(node, number: dict, nears: list[Near], wanted: bool, counted: dict[int, Column]) -> Column:
    """Whether a note matches; counted gets the occurrences of each wanted phrase, by its number."""
    if isinstance(node, Phrase):
        if not node.tokens:
            return F.lit(False)
        i = number[node, None]
        if wanted:
            counted[i] = F.col(f"o{i}")
        return F.exists(f"o{i}", lambda x: F.size(x) > 0)
    if isinstance(node, Near):
        if node not in nears:
            return F.lit(False)
        kept = [F.col(f"near{nears.index(node)}")[f"p{i}"] for i in range(len(node.phrases))]
        if wanted:
            counted.update(zip((number[p, node] for p in node.phrases), kept))
        return F.exists(kept[0], lambda x: F.size(x) > 0)
    if isinstance(node, Without):
        return _decide(node.wanted, number, nears, wanted, counted) & ~_decide(node.unwanted, number, nears, False, counted)
    return reduce(and_ if isinstance(node, Both) else or_, [_decide(x, number, nears, wanted, counted) for x in node.items])


def _leaves(node) -> list[tuple[Phrase, Near | None]]:
    if isinstance(node, Phrase):
        return [(node, None)] if node.tokens else []
    if isinstance(node, Near):
        return [(p, node) for p in node.phrases if p.tokens]
    parts = (node.wanted, node.unwanted) if isinstance(node, Without) else node.items
    return [x for part in parts for x in _leaves(part)]


def match(index: dict[str, DataFrame], expression: str, domain: str | None = None, bodies: bool = False) -> DataFrame:
    """(rel_path, domain, score) of the notes that match, unordered. The score is BM25 over the phrases that may stand; those of a
    NEAR count where they stand within its distance. With bodies for snippets, if asked for."""
    node = parse(expression)
    leaves = list(dict.fromkeys(_leaves(node))) if node else []
    if not leaves:
        return rank.nothing(index, bodies)
    number, nears = {leaf: i for i, leaf in enumerate(leaves)}, _nears(node)
    counted: dict[int, Column] = {}
    met = _decide(node, number, nears, True, counted)
    kept = ["rel_path", "domain", "n_tokens", *(["_body"] if bodies else [])]
    found = _clumped(rank.candidates(index, [p for p, _ in leaves], places=True, bodies=bodies), nears, number)
    found = found.select(*kept, met.alias("met"), *(c.alias(f"o{i}") for i, c in counted.items()))
    marks = [c for i in counted for c in (rank.how_often(leaves[i][0], i, True).alias(f"f{i}"), rank.stands(leaves[i][0], i, True).alias(f"m{i}"))]
    hits = found.select(*kept, "met", *marks)
    stats = rank.figures(index, hits, *(F.count_if(f"m{i}").alias(f"df{i}") for i in counted))
    score = sum((rank.bm25_score(stats, i) for i in counted), F.lit(0.0))
    return rank.chosen(hits, F.col("met") & domain_is(domain), score, bodies)


def with_snippets(index: dict[str, DataFrame], notes: DataFrame, hits: DataFrame, expression: str) -> DataFrame:
    node = parse(expression)
    return rank.with_snippets(index, notes, hits, [[p] for p in phrases_of(node, True)] if node else [])


_CALL = re.compile(r"""'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\b(note_match|text_match)\s*\(\s*'((?:[^']|'')*)'\s*(?:,\s*'((?:[^']|'')*)'\s*)?\)""", re.S | re.I)


def match_views(tables: dict[str, DataFrame], sql: str) -> tuple[dict[str, DataFrame], str]:
    """(views, statement): each note_match('words'[, 'domain']) and text_match('expression'[, 'domain']) of the statement as a view
    (rel_path, score, snippet) of its hits."""
    views: dict[str, DataFrame] = {}
    scan = "postings" not in tables  # texts are read in any case

    def named(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        text, domain, name = m[2].replace("''", "'"), (m[3] or "").replace("''", "'") or None, f"_text_match_{len(views)}"
        if m[1].lower() == "note_match":
            shown = rank.with_snippets(tables, tables["notes"], rank.bm25(tables, text, domain, scan), rank.parse(text))
        else:
            shown = with_snippets(tables, tables["notes"], match(tables, text, domain, scan), text)
        views[name] = shown.select("rel_path", "score", "snippet")
        return name

    return views, _CALL.sub(named, sql)
