"""DuckDB SQL of the operators that SQL can express in whole."""

from __future__ import annotations


def vector_codes(rounds: int = 4, entries: int = 256, parts: int = 4, scale: int = 1024) -> str:
    """op11: the rounds written out, each an assignment and an update."""
    steps, book = [], "b0"
    near = """
a{k} AS MATERIALIZED (
  SELECT p.r, p.part, min({{'d': CAST(list_inner_product(p.x, p.x) + list_inner_product(b.c, b.c) - 2 * list_inner_product(p.x, b.c) AS BIGINT), 'e': b.entry}}) AS best
  FROM p JOIN {book} b ON b.part = p.part GROUP BY p.r, p.part
)"""
    move = """
m{k} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c
  FROM (
    SELECT a.part, a.best.e AS entry, i, sum(CAST(p.x[i] AS BIGINT)) AS s, count(*) AS n
    FROM a{k} a JOIN p ON p.r = a.r AND p.part = a.part, w, unnest(range(1, w.w + 1)) AS t(i) GROUP BY ALL
  ) GROUP BY part, entry
),
b{next} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""
    for k in range(rounds):
        steps += [near.format(k=k, book=book), move.format(k=k, book=book, next=k + 1)]
        book = f"b{k + 1}"
    steps.append(near.format(k=rounds, book=book))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
w AS (SELECT greatest(1, CAST(ceil(max(len(v)) / {parts}) AS BIGINT)) AS w FROM kept),
u AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, list_concat(v, list_transform(range(0, w.w * {parts} - len(v)), lambda x: CAST(0 AS DOUBLE))) AS v
  FROM kept, w
),
p AS MATERIALIZED (SELECT r, part, v[part * w.w + 1 : (part + 1) * w.w] AS x FROM u, w, unnest(range(0, {parts})) AS t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries}),
{",".join(steps)},
final AS (SELECT r, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {book})
SELECT u.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY u.label) AS BIGINT) AS label_error, books.codebooks_sha256 FROM u JOIN final f ON f.r = u.r, books
"""


SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
one AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n, count(*) AS docs FROM one GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
sized AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS size FROM c JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS size FROM kept GROUP BY lang),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(s.size, 0) + 5 * l.v) AS p, 1 + (1000000000 * (k.total + 5)) // (l.size + 5 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN sized s ON s.lang = g.lang AND s.source = g.source
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS t, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term GROUP BY ALL) x
    ON x.lang = a.lang AND x.s = a.source AND x.t = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR k <= 50
"""
