"""SQL twins of the ranked search, for comparison in another engine. Phrases are spelled out, so that reading a query is compared too:
"of the" is two adjacent tokens, "wor*" a prefix."""

from __future__ import annotations

from quillspark.operators.rank import B, K1, LEAST_IDF, WEIGHTS

_NOTES = """SELECT source || '/' || doc_id || '.md' AS rel_path, source AS domain, split_part(text, '.', 1) AS title, lang AS tags, '' AS summary, text AS body FROM documents"""
_TOKENS = ", ".join(f"regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+') AS k_{c}" for c in WEIGHTS)
_SIZE = " + ".join(f"len(k_{c})" for c in WEIGHTS)


def _begins(tokens: str, phrase: str, first: bool = False) -> str:
    """Places (from 0) where the phrase begins in a list of tokens."""
    *head, last = phrase.split()
    tests = [f"{tokens}[i + {j + 1}] = '{w}'" for j, w in enumerate(head)]
    tests.append(f"starts_with({tokens}[i + {len(head) + 1}], '{last[:-1]}')" if last.endswith("*") else f"{tokens}[i + {len(head) + 1}] = '{last}'")
    if first:
        tests.append("i = 0")
    return f"list_filter(range(0, len({tokens}) - {len(head)}), lambda i: {' AND '.join(tests)})"


def _idf(i: int) -> str:
    odds = f"ln((count(*) - count_if(h{i}) + 0.5) / (count_if(h{i}) + 0.5))"
    return f"CASE WHEN {odds} > 0 THEN {odds} ELSE {LEAST_IDF} END AS idf{i}"


def _score(n: int | list[int]) -> str:
    return " + ".join(f"idf{i} * f{i} * {K1 + 1} / (f{i} + {K1} * ({1 - B} + {B} * size / average))" for i in (range(n) if isinstance(n, int) else n))


def _inside(domain: str | None) -> str:
    return "true" if domain is None else f"(domain = '{domain}' OR rel_path ILIKE '{domain}/%')"


def bm25_sql(groups: list[list[str]], domain: str | None = None, limit: int = 10) -> str:
    flat = [p for g in groups for p in g]
    count = lambda c, p: f"len({_begins('k_' + c, p)})"
    f = ", ".join(f"{' + '.join(f'{w} * ' + count(c, p) for c, w in WEIGHTS.items())} AS f{i}, ({' + '.join(count(c, p) for c in WEIGHTS)}) > 0 AS h{i}" for i, p in enumerate(flat))
    at, met = 0, []
    for g in groups:
        met.append(f"CAST({' OR '.join(f'h{i}' for i in range(at, at + len(g)))} AS INT)")
        at += len(g)
    return f"""
WITH notes AS ({_NOTES}), tok AS (SELECT rel_path, domain, {_TOKENS} FROM notes),
cnt AS (SELECT rel_path, domain, {_SIZE} AS size, {f} FROM tok),
st AS (SELECT avg(size) AS average, {', '.join(map(_idf, range(len(flat))))} FROM cnt),
hit AS (SELECT rel_path, {' + '.join(met)} AS met, round(abs({_score(len(flat))}) * 1000) / 1000 AS score FROM cnt, st WHERE {_inside(domain)}),
need AS (SELECT CASE WHEN max(met) = {len(groups)} THEN {len(groups)} ELSE 1 END AS least FROM hit)
SELECT rel_path, score FROM hit, need WHERE met >= least ORDER BY score DESC, rel_path LIMIT {limit}"""


def match_sql(phrases: list[tuple], where: str, scored: list[int], near: tuple[int, ...] = (), distance: int = 10) -> str:
    """phrases: (text, columns or None, whether it begins a column); where: a condition over h0, h1, ..; scored: the phrases that count;
    near: those that count only within a clump of the distance."""
    places = [f"{_begins('k_' + c, p, first) if columns is None or c in columns else '[]::BIGINT[]'} AS s{i}_{c}" for i, (p, columns, first) in enumerate(phrases) for c in WEIGHTS]
    clumps = []
    for c in WEIGHTS:
        for i, (p, columns, first) in enumerate(phrases):
            if i in near:  # starts f of a clump, then what lies in one
                reach = {j: len(phrases[j][0].split()) + distance for j in near}
                heads = [f"list_filter(s{j}_{c}, lambda f: {' AND '.join(f'len(list_filter(s{k}_{c}, lambda x: x >= f AND x <= f + {reach[j]})) > 0' for k in near)})" for j in near]
                clumps.append(f"list_filter(s{i}_{c}, lambda x: {' OR '.join(f'len(list_filter({h}, lambda g: g <= x AND x <= g + {reach[j]})) > 0' for j, h in zip(near, heads))}) AS t{i}_{c}")
            else:
                clumps.append(f"s{i}_{c} AS t{i}_{c}")
    f = ", ".join(f"{' + '.join(f'{w} * len(t{i}_{c})' for c, w in WEIGHTS.items())} AS f{i}, ({' + '.join(f'len(t{i}_{c})' for c in WEIGHTS)}) > 0 AS h{i}" for i in range(len(phrases)))
    return f"""
WITH notes AS ({_NOTES}), tok AS (SELECT rel_path, {_TOKENS} FROM notes),
pla AS (SELECT rel_path, {_SIZE} AS size, {', '.join(places)} FROM tok), clu AS (SELECT rel_path, size, {', '.join(clumps)} FROM pla),
cnt AS (SELECT rel_path, size, {f} FROM clu), st AS (SELECT avg(size) AS average, {', '.join(map(_idf, scored))} FROM cnt)
SELECT rel_path, round(abs({_score(scored)}) * 1000) / 1000 AS score FROM cnt, st WHERE {where}"""


def snippet_sql(hits: str, groups: list[list[str]], words: int = 12) -> str:
    """The hits (rel_path, score) with a snippet of the body."""
    marks = [f"list_transform({_begins('toks', p)}, lambda s: {{'p': {g}, 's': s, 'e': s + {len(p.split())}}})" for g, ps in enumerate(groups) for p in ps]
    return f"""
WITH h AS ({hits}), notes AS ({_NOTES}),
seg AS (SELECT h.rel_path, h.score, regexp_extract_all(coalesce(body, ''), '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+') AS segs FROM h JOIN notes ON notes.rel_path = h.rel_path),
tok AS (SELECT *, list_transform(segs, lambda x: regexp_extract(lower(strip_accents(x)), '[\\p{{L}}\\p{{N}}]+$')) AS toks FROM seg),
occ AS (SELECT *, list_concat({', '.join(marks)}) AS marks FROM tok),
fst AS (SELECT *, list_reverse_sort(list_transform(list_concat([0], list_transform(marks, lambda m: greatest(0, m.s - 1))), lambda s:
  {{'n': len(list_distinct(list_transform(list_filter(marks, lambda m: m.s >= s AND m.s < s + {words}), lambda m: m.p))), 's': -s}}))[1].s AS b FROM occ),
win AS (SELECT rel_path, score, segs, marks, -b AS b, least(-b + {words}, len(segs)) AS e FROM fst),
wrd AS (SELECT *, list_transform(range(b, e), lambda i: {{
  'c': len(list_filter(marks, lambda m: m.s <= i AND i < m.e)) > 0,
  'l': len(list_filter(marks, lambda m: m.s <= i - 1 AND i < m.e)) > 0 AND i > b,
  'r': len(list_filter(marks, lambda m: m.s <= i AND i + 1 < m.e)) > 0 AND i < e - 1, 'i': i, 'x': segs[i + 1]}}) AS w FROM win)
SELECT rel_path, score, CASE WHEN len(segs) = 0 THEN '' ELSE CASE WHEN b > 0 THEN '...' ELSE '' END || array_to_string(list_transform(w, lambda x:
  CASE WHEN x.i = b THEN '' ELSE regexp_extract(x.x, '^[^\\p{{L}}\\p{{N}}]*') END || CASE WHEN x.c AND NOT x.l THEN '**' ELSE '' END
  || regexp_extract(x.x, '[\\p{{L}}\\p{{N}}]+$') || CASE WHEN x.c AND NOT x.r THEN '**' ELSE '' END), '') || CASE WHEN e < len(segs) THEN '...' ELSE '' END END AS snippet FROM wrd"""
