"""Ranked text search: a positional index, query terms, weighted BM25, snippets.

The index has two tables. `postings` says how often (tf) and where (places, the numbers of its tokens) each term stands in each
column of a note; it is written in order of the term, so a query reads the row groups of its own terms only, a prefix those of a
range, and the places only where a phrase, a distance or a snippet needs them. `lengths` has a note's number of tokens. No table
holds tokens' texts: phrases are intersections of places.

An index may also be the notes alone, {"notes": ..}. A query then takes its own tokens from each note in one pass, without a
shuffle, which costs less than an index of all terms where few queries are asked of a table.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.latin import ACCENTED, PLAIN, domain_is, tokens

#: Weight of each searched column; terms in the domain match but add nothing. Fixed values.
WEIGHTS = {"domain": 0.0, "title": 10.0, "tags": 5.0, "summary": 5.0, "body": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Word ends that a variant may lose, the first that fits; fixed values in this order.
SUFFIXES = ["ing", "ed", "es", "s", "er", "able", "ive", "tion", "ment"]
LEAST_HITS, MOST_HITS = 1, 100


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; the last may be a prefix. It may have to stand in some columns, or first in one."""

    tokens: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None
    first: bool = False

    @property
    def by_place(self) -> bool:
        return len(self.tokens) > 1 or self.first


def plain_tokens(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.translate(str.maketrans(ACCENTED, PLAIN)).lower()))


def variants(word: str) -> list[str]:
    """A word, and for longer ones (over 4 bytes) its prefixes and its stem; a prefix ends in *."""
    word = word.lower()
    out = [word]
    size = len(word.encode())
    if size > 4:
        out.append(word + "*")
        for end in SUFFIXES:
            if word.endswith(end) and size - len(end) >= 3:
                out += [word[: -len(end)] + "*", word[: -len(end)]]
                break
    return list(dict.fromkeys(out))


def parse(query: str) -> list[list[Phrase]]:
    """Groups of alternatives: a group for each word, with its variants, or for each quoted phrase."""
    groups = []
    for quoted, word in re.findall(r'"([^"]+)"|(\w+)', query):
        if quoted:
            alternatives = [Phrase(plain_tokens(" ".join(re.findall(r"\w+", quoted))))]
        else:
            alternatives = [Phrase(plain_tokens(v), v.endswith("*")) for v in variants(word)]
        if alternatives := [p for p in alternatives if p.tokens]:
            groups.append(alternatives)
    return groups


def postings(notes: DataFrame) -> DataFrame:
    """(term, rel_path, tf, places): how often and where the term stands in each searched column. Notes are dealt by path before
    their tokens are counted, so tokens themselves aren't shuffled."""
    here = lambda i: lambda t, at: F.struct((F.lit(i << _COLUMN) + at).alias("at"), t.alias("term"))
    placed = [F.transform(tokens(c), here(i)) for i, c in enumerate(WEIGHTS)]
    rows = notes.repartition("rel_path").select("rel_path", F.explode(F.flatten(F.array(*placed))).alias("t")).select("rel_path", "t.at", "t.term")
    each = rows.groupBy("rel_path", "term").agg(F.sort_array(F.collect_list("at")).alias("at"))
    inside = lambda i: F.transform(F.filter("at", lambda x: F.shiftright(x, _COLUMN) == i), lambda x: (x - (i << _COLUMN)).cast("int"))
    out = each.select("term", "rel_path", F.array(*(inside(i) for i in range(len(WEIGHTS)))).alias("places"))
    return out.select("term", "rel_path", F.transform("places", lambda x: F.size(x)).alias("tf"), "places")


#: Bits of a token's number within a column.
_COLUMN = 40


def lengths(notes: DataFrame, placed: DataFrame) -> DataFrame:
    """(rel_path, domain, n_tokens): the number of all tokens of a note, from its postings."""
    sums = placed.groupBy("rel_path").agg(F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_tokens"))
    return notes.select("rel_path", "domain").join(sums, "rel_path", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))


def by_term(rows: DataFrame) -> DataFrame:
    """Postings in the order in which they are written; a common term spreads over several files."""
    return rows.repartitionByRange("term", "rel_path").sortWithinPartitions("term", "rel_path")


def _is(token: str, prefix: bool, term: Column | None = None) -> Column:
    term = F.col("term") if term is None else term
    return term.startswith(token) if prefix else term == token


def _slots(phrases: list[Phrase], places: bool) -> tuple[list[tuple[str, bool]], list[list[int]], list[bool]]:
    """(distinct tokens, which of them each phrase is made of, whether it needs their places)."""
    slots = list(dict.fromkeys((t, p.prefix and n == len(p.tokens) - 1) for p in phrases for n, t in enumerate(p.tokens)))
    number = {s: i for i, s in enumerate(slots)}
    return slots, [[number[t, p.prefix and n == len(p.tokens) - 1] for n, t in enumerate(p.tokens)] for p in phrases], [places or p.by_place for p in phrases]


def _widest(slots: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The slots that hold all others: what begins with a prefix needs no test of its own to be found."""
    return [(t, p) for t, p in slots if not any(wide and t.startswith(u) and (u, wide) != (t, p) for u, wide in slots)]


def occurrences(index: dict[str, DataFrame], phrases: list[Phrase], places: bool = False) -> DataFrame:
    """(rel_path, o0, o1, ..) of the notes that hold any of the tokens: for each phrase how often it stands in each column, or, where
    places are asked for or the phrase needs them, the places where it begins in each."""
    slots, of, by_place = _slots(phrases, places)
    meant = F.filter(F.array(*(F.when(_is(*s), F.lit(i)) for i, s in enumerate(slots))), lambda x: x.isNotNull())
    rows = index["postings"].where(reduce(or_, (_is(*s) for s in slots))).select("rel_path", F.explode(meant).alias("slot"), "tf", *(["places"] if any(by_place) else []))
    own = lambda k, c: F.when(F.col("slot") == k, c)
    counted = sorted({of[i][0] for i, by in enumerate(by_place) if not by})
    placed = sorted({k for i, by in enumerate(by_place) if by for k in of[i]})
    found = rows.groupBy("rel_path").agg(
        *(F.array(*(F.coalesce(F.sum(own(k, F.col("tf")[c])), F.lit(0)).cast("int") for c in range(len(WEIGHTS)))).alias(f"n{k}") for k in counted),
        *(F.collect_list(own(k, F.col("places"))).alias(f"l{k}") for k in placed),
    )
    joined = lambda k, c: F.sort_array(F.flatten(F.transform(f"l{k}", lambda x: x[c])))
    found = found.select("rel_path", *(f"n{k}" for k in counted), *(F.array(*(joined(k, c) for c in range(len(WEIGHTS)))).alias(f"p{k}") for k in placed))
    return found.select("rel_path", *(_of_phrase(p, of[i], by_place[i]).alias(f"o{i}") for i, p in enumerate(phrases)))


def scanned(notes: DataFrame, phrases: list[Phrase], places: bool, keep: list[str], searched: list[str] | None = None) -> DataFrame:
    """The kept columns of every note, n_tokens and o0, o1, .. as above, taken from the texts of the searched columns (all of them)."""
    slots, of, by_place = _slots(phrases, places)
    at = {c: f"_t{i}" for i, c in enumerate(WEIGHTS) if searched is None or c in searched}
    split = notes.select(*keep, *(tokens(c).alias(t) for c, t in at.items()))
    meant = lambda t, i: F.when(reduce(or_, (_is(*s, t) for s in _widest(slots))), F.struct(i.alias("at"), t.alias("term")))
    size = reduce(lambda a, b: a + b, (F.size(t) for t in at.values())).cast("long")
    rows = split.select(*keep, size.alias("n_tokens"), *(F.filter(F.transform(t, meant), lambda x: x.isNotNull()).alias(t) for t in at.values()))
    own = lambda k, c: F.transform(F.filter(at[c], lambda x: _is(*slots[k], x["term"])), lambda x: x["at"]) if c in at else F.array().cast("array<int>")
    counted = sorted({of[i][0] for i, by in enumerate(by_place) if not by})
    placed = sorted({k for i, by in enumerate(by_place) if by for k in of[i]})
    rows = rows.select(*keep, "n_tokens", *(F.array(*(F.size(own(k, c)) for c in WEIGHTS)).alias(f"n{k}") for k in counted), *(F.array(*(own(k, c) for c in WEIGHTS)).alias(f"p{k}") for k in placed))
    return rows.select(*keep, "n_tokens", *(_of_phrase(p, of[i], by_place[i]).alias(f"o{i}") for i, p in enumerate(phrases)))


def candidates(index: dict[str, DataFrame], phrases: list[Phrase], places: bool = False, bodies: bool = False) -> DataFrame:
    """(rel_path, domain, n_tokens, o0, o1, .., and _body if asked for): of the notes that hold any of the tokens, or of all notes if these
    are the index."""
    if "postings" in index:
        found = occurrences(index, phrases, places).join(index["lengths"], "rel_path")
        return found.join(_bodies(index["notes"]), "rel_path") if bodies else found
    return scanned(_with_body(index["notes"]) if bodies else index["notes"], phrases, places, ["rel_path", "domain", *(["_body"] if bodies else [])])


def _with_body(notes: DataFrame) -> DataFrame:
    return notes.withColumn("_body", F.coalesce("body", F.lit("")))


def _bodies(notes: DataFrame) -> DataFrame:
    return _with_body(notes).select("rel_path", "_body")


def _of_phrase(p: Phrase, slots: list[int], by_place: bool) -> Column:
    """A phrase's counts or places by column, nothing in columns where it doesn't count."""
    out = []
    for c, name in enumerate(WEIGHTS):
        if not by_place:
            out.append(F.col(f"n{slots[0]}")[c] if p.columns is None or name in p.columns else F.lit(0))
            continue
        if p.columns is not None and name not in p.columns:
            out.append(F.array().cast("array<int>"))
            continue
        starts = [_earlier(F.col(f"p{k}")[c], n) for n, k in enumerate(slots)]
        here = reduce(F.array_intersect, starts)
        out.append(F.filter(here, lambda x: x == 0) if p.first else here)
    return F.array(*out)


def _earlier(places: Column, n: int) -> Column:
    return F.transform(places, lambda x: x - n)


def _marks(begins: Column, group: int, size: int) -> Column:
    return F.transform(begins, lambda s: F.struct(F.lit(group).alias("p"), s.alias("s"), (s + size).alias("e")))


def _group_marks(numbered: list[tuple[int, Phrase]], column: int) -> list[Column]:
    return [_marks(F.col(f"o{i}")[column], g, len(p.tokens)) for i, (g, p) in enumerate(numbered)]


def how_often(phrase: Phrase, i: int, places: bool = False) -> Column:
    """Weighted number of occurrences of phrase number i."""
    count = lambda j: F.size(F.col(f"o{i}")[j]) if places or phrase.by_place else F.col(f"o{i}")[j]
    return sum((count(j).cast("double") * w for j, w in enumerate(WEIGHTS.values())), F.lit(0.0))


def stands(phrase: Phrase, i: int, places: bool = False) -> Column:
    return F.exists(f"o{i}", lambda x: F.size(x) > 0) if places or phrase.by_place else F.exists(f"o{i}", lambda x: x > 0)


def bm25_score(stats: dict, i: int) -> Column:
    """The part of phrase number i (columns f{i}, n_tokens), by the corpus's figures n, avg and df{i}."""
    df = stats[f"df{i}"]
    idf = math.log((stats["n"] - df + 0.5) / (df + 0.5)) if stats["n"] else 0.0
    idf, own = idf if idf > 0 else LEAST_IDF, F.col(f"f{i}")
    return F.lit(idf) * own * (K1 + 1) / (own + K1 * (1 - B + B * F.col("n_tokens") / F.lit(stats["avg"] or 1.0)))


def thousandths(score: Column) -> Column:
    return F.round(F.abs(score) * 1000) / 1000


def corpus(index: dict[str, DataFrame]) -> DataFrame:
    return index["lengths"].agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("avg"))


def figures(index: dict[str, DataFrame], rows: DataFrame, *wanted: Column) -> dict:
    """The corpus's n and avg, and what is wanted of its candidates."""
    if "postings" in index:
        return corpus(index).join(F.broadcast(rows.agg(*wanted))).first().asDict()  # one row each
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("avg"), *wanted).first().asDict()


def chosen(rows: DataFrame, met: Column, score: Column, bodies: bool = False) -> DataFrame:
    """(rel_path, domain, score) of the rows that meet the condition. It stands in an explode: as a filter the planner would move it below the
    columns that it is made of, and take the tokens of each note twice."""
    shown = F.struct("rel_path", "domain", thousandths(score).alias("score"), *(["_body"] if bodies else []))
    return rows.select(F.explode(F.when(met, F.array(shown))).alias("hit")).select("hit.*")


def bm25(index: dict[str, DataFrame], query: str, domain: str | None = None, bodies: bool = False) -> DataFrame:
    """All hits of a query (rel_path, domain, score), unordered: notes that match each group, or any group if none matches all. With
    bodies for snippets, if asked for."""
    groups = parse(query)
    if not groups:
        return nothing(index, bodies)
    phrases = list(dict.fromkeys(p for g in groups for p in g))
    found = candidates(index, phrases, bodies=bodies)
    hits = found.select("rel_path", "domain", "n_tokens", *(["_body"] if bodies else []), *(c for i, p in enumerate(phrases) for c in (how_often(p, i).alias(f"f{i}"), stands(p, i).alias(f"m{i}"))))
    at = {p: i for i, p in enumerate(phrases)}
    met = sum((F.when(reduce(or_, (F.col(f"m{at[p]}") for p in g)), 1).otherwise(0) for g in groups), F.lit(0))
    inside = domain_is(domain)
    stats = figures(index, hits, F.max(F.when(inside, met)).alias("met"), *(F.count_if(f"m{i}").alias(f"df{i}") for i in range(len(phrases))))
    need = len(groups) if stats["met"] == len(groups) else 1
    score = sum((bm25_score(stats, at[p]) for g in groups for p in g), F.lit(0.0))
    return chosen(hits, inside & (met >= need), score, bodies)


def nothing(index: dict[str, DataFrame], bodies: bool = False) -> DataFrame:
    none = index["lengths" if "postings" in index else "notes"].where(F.lit(False))
    return none.select("rel_path", "domain", F.lit(0.0).alias("score"), *([F.lit("").alias("_body")] if bodies else []))


def top(hits: DataFrame, limit: int = 10) -> DataFrame:
    """The best hits, ties by path; 1 to 100 of them."""
    return hits.orderBy(F.desc("score"), "rel_path").limit(max(LEAST_HITS, min(MOST_HITS, limit)))


def search(index: dict[str, DataFrame], query: str, domain: str | None = None, limit: int = 10) -> DataFrame:
    return top(bm25(index, query, domain), limit)


# --- snippets

SHOWN_WORDS = 12
_WORD = r"[\p{L}\p{N}]+"
_BREAK = r"[^\p{L}\p{N}]*"


def with_snippets(index: dict[str, DataFrame], notes: DataFrame, hits: DataFrame, groups: list[list[Phrase]], words: int = SHOWN_WORDS) -> DataFrame:
    """The hits with a snippet of each body, in which the phrases of each group count as one."""
    numbered = [(g, p) for g, ps in enumerate(groups) for p in ps]
    bodies = hits if "_body" in hits.columns else hits.join(_bodies(notes), "rel_path")
    none = F.array().cast("array<struct<p:int,s:int,e:int>>")
    if not numbered:
        return bodies.withColumn("snippet", snippet(F.col("_body"), none, words)).drop("_body")
    body = list(WEIGHTS).index("body")
    if "postings" not in index:
        rows = scanned(bodies.withColumn("body", F.col("_body")), [p for _, p in numbered], True, bodies.columns, ["body"])
        rows = rows.select(*bodies.columns, F.array_distinct(F.concat(*_group_marks(numbered, body))).alias("_marks"))
        return rows.withColumn("snippet", snippet(F.col("_body"), F.col("_marks"), words)).drop("_body", "_marks")
    found = occurrences({"postings": index["postings"].join(hits.select("rel_path"), "rel_path", "left_semi")}, [p for _, p in numbered], places=True)
    marked = found.select("rel_path", F.array_distinct(F.concat(*_group_marks(numbered, body))).alias("_marks"))
    shown = bodies.join(marked, "rel_path", "left").withColumn("snippet", snippet(F.col("_body"), F.coalesce("_marks", none), words))
    return shown.drop("_body", "_marks")


def snippet(body: Column, marks: Column, words: int = SHOWN_WORDS) -> Column:
    """The stretch of so many words in which the most different p begin, the first of equals, with what is found between ** marks.

    marks are (p, s, e): tokens s to e - 1 of the body. A stretch may begin at the first word or at the word before one found; what overlaps is
    marked as one, and what reaches over the stretch's ends is marked as far as these."""
    pieces = F.regexp_extract_all(body, F.lit(_BREAK + _WORD), 0)  # each word with what stands before it
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(marks, lambda m: F.greatest(F.lit(0), m["s"] - 1))))
    kinds = lambda s: F.size(F.array_distinct(F.transform(F.filter(marks, lambda m: (m["s"] >= s) & (m["s"] < s + words)), lambda m: m["p"])))
    best = -F.array_max(F.transform(starts, lambda s: F.struct(kinds(s).alias("n"), (-s).alias("s"))))["s"]
    end = F.least(best + words, F.size(pieces))
    covered = lambda i: F.exists(marks, lambda m: (m["s"] <= i) & (i < m["e"]))
    goes_on = lambda i: F.exists(marks, lambda m: (m["s"] <= i) & (i + 1 < m["e"]))

    def shown(i: Column) -> Column:
        piece = F.get(pieces, i)
        opens, closes = covered(i) & ((i == best) | ~goes_on(i - 1)), covered(i) & ((i == end - 1) | ~goes_on(i))
        before = F.when(i == best, F.lit("")).otherwise(F.regexp_extract(piece, "^" + _BREAK, 0))
        return F.concat(before, F.when(opens, F.lit("**")).otherwise(F.lit("")), F.regexp_extract(piece, _WORD + "$", 0), F.when(closes, F.lit("**")).otherwise(F.lit("")))

    text = F.array_join(F.transform(F.sequence(best, end - 1), shown), "")
    dots = lambda c: F.when(c, F.lit("...")).otherwise(F.lit(""))
    return F.when(F.size(pieces) == 0, F.lit("")).otherwise(F.concat(dots(best > 0), text, dots(end < F.size(pieces))))
