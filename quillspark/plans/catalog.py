"""Registered queries over the Parquet tables and their SQL twins."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.latin import domain_is
from quillspark.operators import audit, diff, frames, fulltext, fuse, graph, keypaths, lists, rank, sqlgate, vector
from quillspark.plans import adapters as A
from quillspark.plans import note_queries  # noqa: F401  (registers its queries)
from quillspark.plans.bm25_sql import bm25_sql, match_sql, snippet_sql
from quillspark.plans.project import parse_notes, views
from quillspark.plans.registry import oracle_sql, queries, query  # noqa: F401

# --- ranked search

#: A query, its domain, and how it is to be read: a group of alternatives a word.
_WORTHLESS = [["worthless", "worthless*", "worthles*", "worthles"]]
_SEARCHES = {
    "bm25_single": ("worthless", None, _WORTHLESS),
    "bm25_and": ("the thing", None, [["the"], ["thing", "thing*"]]),
    "bm25_or_fallback": ("idiot zzzunknown moron", None, [["idiot", "idiot*"], ["zzzunknown", "zzzunknown*"], ["moron", "moron*"]]),
    "bm25_prefix": ("worth", None, [["worth", "worth*"]]),
    "bm25_phrase": ('"of the"', None, [["of the"]]),
    "bm25_stemming": ("working", None, [["working", "working*", "work*", "work"]]),
    "bm25_accent": ("école für", None, [["ecole", "ecole*"], ["fur"]]),
    "bm25_domain": ("scum loser", "src3", [["scum"], ["loser", "loser*", "los*", "los"]]),
}
for _name, (_text, _domain, _groups) in _SEARCHES.items():

    def _search(spark: SparkSession, sf_dir: str, text=_text, domain=_domain) -> DataFrame:
        return rank.search(A.text_index(spark, sf_dir), text, domain).select("rel_path", "score")

    query(_name, bm25_sql(_groups, _domain))(_search)

#: An expression, its phrases (text, columns, first), the condition, the phrases that count, and those of a NEAR with its distance.
_MATCHES = {
    "match_phrase": ('"of the" "in the"', [("of the", None, False), ("in the", None, False)], "h0 AND h1", [0, 1], (), 0),
    "match_prefix_phrase": ("of + th*", [("of th*", None, False)], "h0", [0], (), 0),
    "match_columns": ("title : worth* OR {title tags} : the OR - body : of", [("worth*", ["title"], False), ("the", ["title", "tags"], False), ("of", ["domain", "title", "tags", "summary"], False)], "h0 OR h1 OR h2", [0, 1, 2], (), 0),
    "match_boolean": ("(worthless OR idiot moron) AND the NOT (scum OR src3)", [("worthless", None, False), ("idiot", None, False), ("moron", None, False), ("the", None, False), ("scum", None, False), ("src3", None, False)], "(h0 OR h1 AND h2) AND h3 AND NOT (h4 OR h5)", [0, 1, 2, 3], (), 0),
    "match_near": ('NEAR(the "of the" wor*, 4)', [("the", None, False), ("of the", None, False), ("wor*", None, False)], "h0", [0, 1, 2], (0, 1, 2), 4),
    "match_first": ("^the OR title : ^a*", [("the", None, True), ("a*", ["title"], True)], "h0 OR h1", [0, 1], (), 0),
}
for _name, (_text, *_twin) in _MATCHES.items():

    def _match(spark: SparkSession, sf_dir: str, text=_text) -> DataFrame:
        return fulltext.match(A.text_index(spark, sf_dir), text).select("rel_path", "score")

    query(_name, match_sql(*_twin))(_match)


@query("match_snippet", snippet_sql(match_sql([("of the", None, False), ("wor*", None, False)], "h0 AND h1", [0, 1]), [["of the"], ["wor*"]]))
def match_snippet(spark, sf_dir):
    index, notes, text = A.text_index(spark, sf_dir), A.notes(spark, sf_dir), '"of the" AND wor*'
    return fulltext.with_snippets(index, notes, fulltext.match(index, text, bodies=True), text).select("rel_path", "score", "snippet")


@query("bm25_snippet", snippet_sql(bm25_sql(_WORTHLESS), _WORTHLESS))
def bm25_snippet(spark, sf_dir):
    index, text = A.text_index(spark, sf_dir), "worthless"
    return rank.with_snippets(index, A.notes(spark, sf_dir), rank.search(index, text), rank.parse(text)).select("rel_path", "score", "snippet")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = A.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


_DOT = "round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) * 10000) / 10000"


@query("vector_topk", f"SELECT vec_id, {_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return vector.top_k(A.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, "embedding", "vec_id").select("vec_id", "score")


@query("vector_best_per_note", f"""
WITH s AS (SELECT label, vec_id, {_DOT} AS score FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s)
SELECT label, vec_id, score FROM r WHERE k = 1 ORDER BY score DESC, label LIMIT 10""")
def vector_best_per_note(spark, sf_dir):
    return vector.best_per_note(A.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, "embedding", "label", "vec_id").select("label", "vec_id", "score")


_META = "SELECT 'd' || doc_id AS rel_path, sha256(text) AS content_hash FROM documents WHERE doc_id % 9 <> 4"
_STORED = "SELECT 'd' || vec_id AS rel_path, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS content_hash, vec_id FROM embeddings LEFT JOIN documents ON doc_id = vec_id"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(notes, their vectors) of a state in which some notes changed or went after they were embedded."""
    d, e = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "embeddings")
    own = F.sha2("text", 256).alias("content_hash")
    meta = d.where("doc_id % 9 <> 4").select(F.concat(F.lit("d"), "doc_id").alias("rel_path"), own)
    made = e.join(d, d["doc_id"] == e["vec_id"], "left").select(F.concat(F.lit("d"), "vec_id").alias("rel_path"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise(F.sha2("text", 256)).alias("content_hash"), "vec_id")
    return meta, made


@query("vector_sync", f"WITH m AS ({_META}), v AS ({_STORED}) SELECT rel_path, content_hash FROM m WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.rel_path = m.rel_path AND v.content_hash = m.content_hash)")
def vector_sync(spark, sf_dir):
    return vector.to_embed(*_stored(spark, sf_dir))


@query("vector_orphans", f"WITH m AS ({_META}), v AS ({_STORED}) SELECT rel_path, vec_id FROM v WHERE rel_path NOT IN (SELECT rel_path FROM m)")
def vector_orphans(spark, sf_dir):
    meta, made = _stored(spark, sf_dir)
    return vector.orphans(made, meta).select("rel_path", "vec_id")


@query("vector_current", f"WITH m AS ({_META}), v AS ({_STORED}) SELECT v.rel_path, v.vec_id FROM v JOIN m ON v.rel_path = m.rel_path AND v.content_hash = m.content_hash")
def vector_current(spark, sf_dir):
    meta, made = _stored(spark, sf_dir)
    return vector.still_current(made, meta).select("rel_path", "vec_id")


@query("vector_pack", "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings")
def vector_pack(spark, sf_dir):
    packed = A.table(spark, sf_dir, "embeddings").select("vec_id", vector.to_blob("embedding").alias("blob"))
    back = packed.select("vec_id", F.octet_length("blob").cast("bigint").alias("n_bytes"), vector.from_blob("blob").alias("v"))
    return back.select("vec_id", "n_bytes", F.col("v")[0].cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"))


def hybrid(spark: SparkSession, sf_dir: str, text: str, limit: int = 10) -> DataFrame:
    """Keyword and vector hits of max(2 * limit, 20) each, fused."""
    wide = max(2 * limit, 20)
    keyword = rank.search(A.text_index(spark, sf_dir), text, None, wide).select("rel_path", "score")
    near = vector.top_k(A.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), wide, "embedding", "vec_id")
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("rel_path"))
    return fuse.rrf([keyword, near.join(docs, "vec_id").select("rel_path", "score")], limit)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, "idiot moron")


@query("rrf_hybrid", f"""
WITH kw AS ({bm25_sql([["idiot", "idiot*"], ["moron", "moron*"]], None, 20)}),
ve AS (SELECT vec_id, {_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20),
vp AS (SELECT source || '/' || doc_id || '.md' AS rel_path, score FROM ve JOIN documents ON doc_id = vec_id),
a AS (SELECT rel_path, 1 / (60.0 + row_number() OVER (ORDER BY score DESC, rel_path)) AS s FROM kw
      UNION ALL SELECT rel_path, 1 / (60.0 + row_number() OVER (ORDER BY score DESC, rel_path)) FROM vp),
t AS (SELECT rel_path, sum(s) AS s FROM a GROUP BY rel_path ORDER BY s DESC, rel_path LIMIT 10)
SELECT rel_path, round(s * 10000) / 10000 AS score FROM t""")
def rrf_hybrid(spark, sf_dir):
    return flagship(spark, sf_dir)


# --- graph

_EDGES = """
n AS (SELECT * FROM nation), places AS (
  SELECT 'nation/' || n_name || '.md' AS rel_path, n_name AS stem FROM nation UNION ALL SELECT 'region/' || r_name || '.md', r_name FROM region),
edges AS (
  SELECT 'nation/' || n_name || '.md' AS source_rel, r_name AS target_stem, 'part_of' AS relation_type FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier/' || replace(s_name, '#', '-') || '.md', n_name, 'located_in' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer/' || replace(c_name, '#', '-') || '.md', n_name, 'lives_in' FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_TARGET = "(SELECT min(n_name) FROM nation)"


def _target(spark: SparkSession, sf_dir: str) -> str:
    return A.table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0] or ""


@query("blast_up", f"WITH {_EDGES} SELECT source_rel, relation_type FROM edges WHERE lower(target_stem) = lower({_TARGET})")
def blast_up(spark, sf_dir):
    return graph.upstream(A.place_edges(spark, sf_dir), f"[[nation/{_target(spark, sf_dir)}|x]]")


@query("blast_down", f"WITH {_EDGES} SELECT target_stem, relation_type FROM edges WHERE source_rel IN (SELECT rel_path FROM places WHERE stem = {_TARGET})")
def blast_down(spark, sf_dir):
    return graph.downstream(A.place_edges(spark, sf_dir), A.place_notes(spark, sf_dir), _target(spark, sf_dir))


@query("blast_sinks", f"""
SELECT s_name AS name, s_name || '_*' AS container_prefix, CAST(s_suppkey AS VARCHAR) AS ports, 'local' AS host, 'default' AS network, 'nation/' || n_name || '.md' AS rel_path
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = {_TARGET}""")
def blast_sinks(spark, sf_dir):
    return graph.sinks(A.place_services(spark, sf_dir), spark.createDataFrame([(_target(spark, sf_dir),)], "stem string"))


@query("blast_radius", f"""
WITH {_EDGES} SELECT {_TARGET} AS target,
  (SELECT count(*) FROM edges WHERE target_stem = {_TARGET}) AS n_up, (SELECT min(source_rel) FROM edges WHERE target_stem = {_TARGET}) AS first_up,
  (SELECT count(*) FROM edges WHERE source_rel = 'nation/' || {_TARGET} || '.md') AS n_down,
  (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = {_TARGET}) AS n_sinks""")
def blast_radius(spark, sf_dir):
    b = graph.blast(A.place_edges(spark, sf_dir), A.place_notes(spark, sf_dir), A.place_services(spark, sf_dir), _target(spark, sf_dir))
    up = b["upstream"].agg(F.count(F.lit(1)).alias("n_up"), F.min("source_rel").alias("first_up"))
    rest = [b[k].agg(F.count(F.lit(1)).alias(n)) for k, n in (("downstream", "n_down"), ("boundary_sinks", "n_sinks"))]
    one = spark.createDataFrame([(_target(spark, sf_dir),)], "target string")
    return one.join(up).join(rest[0]).join(rest[1])  # one row each


def _tree_sql(edges: str, root: str, depth: int, a: str = "f", b: str = "t") -> str:
    return f"""
WITH RECURSIVE {edges}, tree(path, keys, node, depth, relation_type, cycle) AS (
  SELECT CAST([] AS VARCHAR[]), [{root}], {root}, 0, '', false
  UNION ALL
  SELECT list_append(t.path, e.{b}), list_append(t.keys, e.{b}), e.{b}, t.depth + 1, e.relation_type, list_contains(t.keys, e.{b})
  FROM tree t JOIN ed e ON e.{a} = t.node WHERE NOT t.cycle AND t.depth < {depth})
SELECT array_to_string(path, '/') AS path, depth, path[-1] AS stem, relation_type, cycle FROM tree WHERE depth > 0"""


def _tree(rows: DataFrame) -> DataFrame:
    return rows.select(F.array_join("path", "/").alias("path"), "depth", "stem", "relation_type", "cycle")


_NAMED = _EDGES + ", ed AS (SELECT regexp_extract(source_rel, '([^/]*)\\.md$', 1) AS f, target_stem AS t, relation_type FROM edges)"


def _reach_sql(edges: str, root: str, depth: int, a: str, b: str) -> str:
    return f"""
WITH RECURSIVE {edges}, found(stem, depth) AS (
  SELECT {root}, 0 UNION SELECT e.{b}, r.depth + 1 FROM found r JOIN ed e ON e.{a} = r.stem WHERE r.depth < {depth})
SELECT stem, CAST(min(depth) AS INTEGER) AS depth FROM found GROUP BY stem"""


@query("reach_up", _reach_sql(_NAMED, "(SELECT min(r_name) FROM region)", 5, "t", "f"))
def reach_up(spark, sf_dir):
    start = A.table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0] or ""
    return graph.reach(graph.edges(A.place_edges(spark, sf_dir), A.place_notes(spark, sf_dir)), start, 5, "up")


_FOLLOWING = """f AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
ed AS (SELECT DISTINCT event_type AS f, next AS t FROM f WHERE next IS NOT NULL)"""


@query("reach_cycle", _reach_sql(_FOLLOWING, "(SELECT min(event_type) FROM events)", 5, "f", "t"))
def reach_cycle(spark, sf_dir):
    start = A.table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0] or ""
    links = A.transitions(spark, sf_dir)
    notes = links.select(F.col("source_rel").alias("rel_path"), F.regexp_replace("source_rel", r"\.md$", "").alias("stem")).distinct()
    return graph.reach(graph.edges(links, notes), start, 5, "down")


@query("reach_sinks", f"""
WITH RECURSIVE {_NAMED}, found(stem, depth) AS (
  SELECT (SELECT min(r_name) FROM region), 0 UNION SELECT e.f, r.depth + 1 FROM found r JOIN ed e ON e.t = r.stem WHERE r.depth < 5)
SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS ports FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE lower(n_name) IN (SELECT lower(stem) FROM found) OR lower(s_name) IN (SELECT lower(stem) FROM found)""")
def reach_sinks(spark, sf_dir):
    return graph.sinks(A.place_services(spark, sf_dir), reach_up(spark, sf_dir)).select("name", "ports")


@query("map_down", _tree_sql(_NAMED, "(SELECT min(replace(s_name, '#', '-')) FROM supplier)", 3))
def map_down(spark, sf_dir):
    start = A.table(spark, sf_dir, "supplier").agg(F.min(F.translate("s_name", "#", "-"))).first()[0] or ""
    return _tree(graph.traverse(graph.edges(A.place_edges(spark, sf_dir), A.place_notes(spark, sf_dir)), start, 3))


@query("map_up", _tree_sql(_NAMED, "(SELECT min(r_name) FROM region)", 2, "t", "f"))
def map_up(spark, sf_dir):
    start = A.table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0] or ""
    return _tree(graph.traverse(graph.edges(A.place_edges(spark, sf_dir), A.place_notes(spark, sf_dir)), start, 2, "up"))


_NEXT = """tr AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
ed AS (SELECT DISTINCT event_type AS f, nxt AS t, 'then' AS relation_type FROM tr WHERE nxt IS NOT NULL)"""


@query("map_cycle", _tree_sql(_NEXT, "(SELECT min(event_type) FROM events)", 3))
def map_cycle(spark, sf_dir):
    start = A.table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0] or ""
    none = spark.createDataFrame([], "rel_path string, stem string")
    return _tree(graph.traverse(graph.edges(A.transitions(spark, sf_dir), none), start, 3))


@query("contract", f"""
WITH {_EDGES} SELECT p.rel_path, p.stem, coalesce((SELECT string_agg(s_name || ': ' || s_suppkey, ',' ORDER BY s_name || ': ' || s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = p.stem), '') AS ports,
  coalesce((SELECT string_agg(source_rel, ',' ORDER BY source_rel) FROM edges WHERE target_stem = p.stem), '') AS dependents,
  coalesce((SELECT string_agg(target_stem, ',' ORDER BY target_stem) FROM edges WHERE source_rel = p.rel_path), '') AS dependencies
FROM places p""")
def contract(spark, sf_dir):
    empty = lambda c: spark.createDataFrame([], f"source_rel string, {c} string")
    c = graph.contracts(A.place_notes(spark, sf_dir), A.place_edges(spark, sf_dir), A.place_services(spark, sf_dir), empty("invariant_text"), empty("command"))
    return c.select("rel_path", "stem", *(F.array_join(x, ",").alias(x) for x in ("ports", "dependents", "dependencies")))


@query("attach_graph", f"""
WITH {_EDGES}, u AS (SELECT target_stem AS stem, source_rel || ' (' || relation_type || ')' AS t, row_number() OVER (PARTITION BY target_stem ORDER BY source_rel, relation_type) AS k FROM edges),
v AS (SELECT n_name AS stem, s_name || ':' || s_suppkey AS t, row_number() OVER (PARTITION BY n_name ORDER BY s_name) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT p.rel_path, (SELECT string_agg(t, ';' ORDER BY k) FROM u WHERE u.stem = p.stem AND k <= 5) AS upstream,
  (SELECT string_agg(target_stem || ' (' || relation_type || ')', ';') FROM edges WHERE source_rel = p.rel_path) AS downstream,
  (SELECT string_agg(t, ';' ORDER BY k) FROM v WHERE v.stem = p.stem AND k <= 3) AS services
FROM places p WHERE starts_with(p.rel_path, 'nation/')""")
def attach_graph(spark, sf_dir):
    hits = A.place_notes(spark, sf_dir).where("type = 'nation'").select("rel_path", "stem")
    out = fuse.attach_graph(hits, A.place_edges(spark, sf_dir), A.place_services(spark, sf_dir))
    return out.select("rel_path", *(F.array_join(c, ";").alias(c) for c in ("upstream", "downstream", "services")))


@query("resolve_ambiguous", """
SELECT c_custkey AS k, 'customer/' || c_custkey || '.md' AS rel_path FROM customer WHERE lower(c_mktsegment) = (SELECT lower(min(c_mktsegment)) FROM customer)""")
def resolve_ambiguous(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("customer/"), "c_custkey", F.lit(".md")).alias("rel_path"), F.concat(F.lit("s"), "c_custkey").alias("stem"), F.col("c_mktsegment").alias("title"))
    return graph.resolve(c, c.agg(F.min("title")).first()[0].lower()).select("k", "rel_path")


@query("resolve_note", "SELECT 'nation/' || n_name || '.md' AS rel_path, n_name AS stem FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def resolve_note(spark, sf_dir):
    return graph.resolve(A.place_notes(spark, sf_dir), _target(spark, sf_dir).upper()).select("rel_path", "stem")


# --- list queries and filters


@query("list_notes", "SELECT source || '/' || doc_id || '.md' AS rel_path, lang AS tags FROM documents WHERE source = 'src3' OR source || '/' || doc_id || '.md' ILIKE 'src3/%'")
def list_notes(spark, sf_dir):
    return A.notes(spark, sf_dir).where(domain_is("src3/", blank_is_none=False)).select("rel_path", "tags").orderBy("rel_path")


@query("list_projects", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND coalesce(o_orderpriority, '') <> '5-LOW' AND NOT o_orderpriority ILIKE '%-MEDIUM'")
def list_projects(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").withColumns({"domain": F.col("o_orderstatus"), "type": F.col("o_orderpriority"), "stem": F.col("o_orderpriority")})
    return lists.projects(o, "O", "5-LOW", "-MEDIUM").select("o_orderkey", "o_orderpriority")


@query("list_services", "SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS ports, 'nation/' || n_name || '.md' AS rel_path FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def list_services(spark, sf_dir):
    return lists.services(A.place_services(spark, sf_dir)).select("name", "ports", "rel_path")


#: Paths into the notes of suppliers and nations: fields of services, lists, maps, names in another case, what leads nowhere.
@query("keypath_get", """
WITH s AS (SELECT replace(s_name, '#', '-') AS f, * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT f || '.ports.0' AS path, 'notes' AS source, 'supplier/' || f || '.md' AS rel_path, '"' || s_suppkey || ':80"' AS value FROM s
UNION ALL SELECT lower(f) || '.tags.1', 'notes', 'supplier/' || f || '.md', '"' || n_name || '"' FROM s
UNION ALL SELECT 'supplier/' || f || '.relations.located_in', 'notes', 'supplier/' || f || '.md', '"[[nation/' || n_name || '|home]]"' FROM s
UNION ALL SELECT 'entities.' || f || '.ports', 'entities', 'supplier/' || f || '.md', '["' || s_suppkey || ':80"]' FROM s
UNION ALL SELECT 'services.' || f || '.ports', 'services', 'supplier/' || f || '.md', '"' || s_suppkey || ':80"' FROM s
UNION ALL SELECT f || '.tags.7', 'notes', 'supplier/' || f || '.md', NULL FROM s
UNION ALL SELECT ' ' || n_name || ' . summary', 'notes', 'nation/' || n_name || '.md', '"in ' || r_name || '"' FROM n""")
def keypath_get(spark, sf_dir):
    raw = A.markdown_notes(spark, sf_dir)
    t = views(parse_notes(raw, "local"))
    name, nation = F.regexp_extract("rel_path", r"([^/]*)\.md$", 1), F.col("rel_path").startswith("nation/")
    forms = [F.concat(name, F.lit(".ports.0")), F.concat(F.lower(name), F.lit(".tags.1")), F.concat(F.lit("supplier/"), name, F.lit(".relations.located_in")), F.concat(F.lit("entities."), name, F.lit(".ports")), F.concat(F.lit("services."), name, F.lit(".ports")), F.concat(name, F.lit(".tags.7"))]
    asked = F.when(nation, F.array(F.concat(F.lit(" "), name, F.lit(" . summary")))).otherwise(F.array(*forms))
    return keypaths.lookup(raw.select(F.explode(asked).alias("path")), t["services"], t["entities"])


@query("link_class", """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT CASE WHEN regexp_matches(target, '^#|^[A-Za-z][A-Za-z0-9+.-]+:') THEN 'external' ELSE 'local' END AS kind, count(*) AS n FROM h GROUP BY 1""")
def link_class(spark, sf_dir):
    return audit.hrefs(A.table(spark, sf_dir, "pages")).groupBy(F.when(audit.is_external("target"), "external").otherwise("local").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- quality audits

_PAGES = """h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)"""


@query("link_broken", f"WITH {_PAGES} SELECT page_id, target FROM h WHERE target NOT IN (SELECT url FROM pages) GROUP BY ALL")
def link_broken(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages")
    return audit.broken(audit.hrefs(pages), pages.select(F.col("url").alias("path")))


@query("link_orphan", f"WITH {_PAGES} SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.target = p.url AND h.page_id <> p.page_id)")
def link_orphan(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages")
    inbound = audit.hrefs(pages).select(F.col("target").alias("url"), F.col("page_id").alias("source_id"))
    return pages.join(inbound, (pages["url"] == inbound["url"]) & (pages["page_id"] != inbound["source_id"]), "left_anti").select("page_id", "url")


@query("lint_required", """
SELECT doc_id, concat_ws(', ', CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END, CASE WHEN lang IS NULL OR lang <> 'en' THEN 'lang' END,
  CASE WHEN NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'label' END) AS missing
FROM documents d WHERE trim(coalesce(text, '')) = '' OR lang IS NULL OR lang <> 'en' OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def lint_required(spark, sf_dir):
    d, labels = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has_label")).distinct()
    rules = {"text": F.trim(F.coalesce("text", F.lit(""))) != "", "lang": F.coalesce(F.col("lang") == "en", F.lit(False)), "label": F.col("has_label").isNotNull()}
    return audit.missing(d.select("doc_id", "text", "lang").join(labels, "doc_id", "left"), rules).select("doc_id", F.array_join("missing", ", ").alias("missing"))


_OLD = "SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0"
_NEW = "SELECT doc_id AS id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0"
_DIFF = f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS status FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.id = n.id"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change between two states of one table: what is filtered here is the case, not a limit."""
    d = A.table(spark, sf_dir, "documents")
    old = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("content_hash"))
    return diff.diff(old, new, "id")


@query("sync_diff", _DIFF)
def sync_diff(spark, sf_dir):
    return _changes(spark, sf_dir)


@query("sync_counters", f"""WITH d AS ({_DIFF}) SELECT count_if(status = 'added') AS added, count_if(status IN ('added', 'updated')) AS updated,
  count_if(status = 'deleted') AS deleted, count_if(status = 'unchanged') AS unchanged, count_if(status <> 'deleted') AS total FROM d""")
def sync_counters(spark, sf_dir):
    return diff.counters(_changes(spark, sf_dir))


# --- what user SQL reaches (J16, A13, §2.7, §2.9, §2.19)

_PASS = {
    "sql_inner_join": "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "sql_left_join": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "sql_full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k",
    "sql_natural_using": "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)",
    "sql_cross_join": "SELECT r_name, p_size FROM region CROSS JOIN (SELECT DISTINCT p_size FROM part WHERE p_size < 4) p",
    "sql_semi_join": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "sql_anti_join": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "sql_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 AND l_partkey IS NOT NULL)",
    "sql_theta_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_group_having": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "sql_window_rank": "SELECT o_orderkey, o_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "sql_window_analytic": "SELECT event_id, lag(value) OVER w AS prev, lead(value) OVER w AS next, first_value(value) OVER w AS first, last_value(value) OVER w AS last, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "sql_window_frames": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM events",
    "sql_union": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "sql_union_all": "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "sql_recursive": "WITH RECURSIVE up(k, a, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT k, CAST(floor(a / 2) AS BIGINT), depth + 1 FROM up WHERE a > 1) SELECT k, max(depth) AS depth, sum(a) AS path_sum FROM up GROUP BY k",
    "sql_scalar_subquery": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS most FROM customer c",
    "sql_case_cast": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'medium' ELSE 'large' END AS size, CAST(floor(p_retailprice) AS INT) AS price, upper(substr(p_name, 1, 3)) AS name FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) OR p_name LIKE '%a%'",
    "sql_order_nulls": "SELECT doc_id, toxic FROM (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x ORDER BY toxic NULLS LAST, doc_id LIMIT 50 OFFSET 10",
    "sql_group_concat": "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, coalesce(sum(n_nationkey), 0.0) AS total FROM nation GROUP BY n_regionkey",
    "sql_rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)",
}
_SPARK_DIALECT = {"sql_group_concat": ("string_agg(n_name, ', ' ORDER BY n_name)", "listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)")}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _pass_through(name: str, sql: str):
    text = sql.replace(*_SPARK_DIALECT[name]) if name in _SPARK_DIALECT else sql

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sqlgate.frame(spark, {t: A.table(spark, sf_dir, t) for t in sorted(set(re.findall(r"\w+", text)) & set(_TABLES))}, text)


@query("sql_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def sql_dates(spark, sf_dir):
    text = "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, date_format(o_orderdate, 'yyyy-MM') AS ym, CAST(datediff(o_orderdate, DATE '1992-01-01') AS BIGINT) AS days FROM orders"
    return sqlgate.frame(spark, {"orders": A.table(spark, sf_dir, "orders")}, text)


_LINES = "SELECT l_orderkey, l_linenumber, {} FROM lineitem"


def _frame_sql(**columns: str) -> str:
    return _LINES.format(", ".join(f"CAST({c} AS BIGINT) AS {name}" for name, c in columns.items()))


_GROUPED = "OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN {} {})"
_NEIGHBOURS = "1 PRECEDING AND 2 FOLLOWING"


@query("frame_groups", _frame_sql(
    total=f"sum(l_linenumber) {_GROUPED.format(_NEIGHBOURS, '')}", least=f"min(l_orderkey) {_GROUPED.format(_NEIGHBOURS, '')}",
    returned=f"count(*) FILTER (WHERE l_returnflag = 'R') {_GROUPED.format(_NEIGHBOURS, '')}", before=f"sum(l_linenumber) {_GROUPED.format('UNBOUNDED PRECEDING AND 1 PRECEDING', '')}"))
def frame_groups(spark, sf_dir):
    near = frames.Frame(("l_suppkey",), ("l_quantity",), "groups", -1, 2)
    lines, n = A.table(spark, sf_dir, "lineitem"), F.col("l_linenumber").cast("bigint")
    here = dict(total=("sum", n), least=("min", F.col("l_orderkey")), returned=("count", None, F.col("l_returnflag") == "R"))
    return frames.over_each(lines, [(near, here), (replace(near, start=None, end=-1), dict(before=("sum", n)))]).select("l_orderkey", "l_linenumber", "total", "least", "returned", "before")


@query("frame_exclude", _frame_sql(
    alone=f"sum(l_linenumber) {_GROUPED.format(_NEIGHBOURS, 'EXCLUDE CURRENT ROW')}", most=f"max(l_orderkey) {_GROUPED.format(_NEIGHBOURS, 'EXCLUDE CURRENT ROW')}",
    others=f"sum(l_linenumber) {_GROUPED.format(_NEIGHBOURS, 'EXCLUDE GROUP')}", least=f"min(l_orderkey) {_GROUPED.format(_NEIGHBOURS, 'EXCLUDE GROUP')}",
    untied=f"count(*) {_GROUPED.format(_NEIGHBOURS, 'EXCLUDE TIES')}", returned=f"sum(l_linenumber) FILTER (WHERE l_returnflag = 'R') {_GROUPED.format(_NEIGHBOURS, 'EXCLUDE TIES')}"))
def frame_exclude(spark, sf_dir):
    near = frames.Frame(("l_suppkey",), ("l_quantity",), "groups", -1, 2)
    n, key = F.col("l_linenumber").cast("bigint"), F.col("l_orderkey")
    out = frames.over_each(A.table(spark, sf_dir, "lineitem"), [
        (replace(near, exclude="current row"), dict(alone=("sum", n), most=("max", key))),
        (replace(near, exclude="group"), dict(others=("sum", n), least=("min", key))),
        (replace(near, exclude="ties"), dict(untied=("count", None), returned=("sum", n, F.col("l_returnflag") == "R"))),
    ])
    return out.select("l_orderkey", "l_linenumber", "alone", "most", "others", "least", "untied", "returned")


_ROWED = "sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_quantity ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {})"


@query("frame_rows_exclude", "SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, CAST(sum({}) AS BIGINT) AS alone, CAST(sum({}) AS BIGINT) AS others, CAST(sum({}) AS BIGINT) AS untied, count(*) AS n FROM (SELECT *, {} AS a, {} AS b, {} AS c FROM lineitem) GROUP BY l_suppkey, l_quantity".format(
    "a", "b", "c", *(_ROWED.format(x) for x in ("CURRENT ROW", "GROUP", "TIES"))))
def frame_rows_exclude(spark, sf_dir):
    near = frames.Frame(("l_suppkey",), ("l_quantity",), "rows", -3, 2)
    n = F.col("l_quantity").cast("bigint")
    each = [(replace(near, exclude=without), {name: ("sum", n)}) for name, without in (("alone", "current row"), ("others", "group"), ("untied", "ties"))]
    out = frames.over_each(A.table(spark, sf_dir, "lineitem"), each)
    summed = [F.sum(c).alias(c) for c in ("alone", "others", "untied")]
    return out.groupBy("l_suppkey", n.alias("quantity")).agg(*summed, F.count(F.lit(1)).alias("n"))


@query("sql_note_match", f"SELECT count(*) AS hits, sum(score) AS score, count(*) FILTER (WHERE snippet LIKE '%**%') AS marked FROM ({snippet_sql(bm25_sql(_WORTHLESS, None, 100000), _WORTHLESS)})")
def sql_note_match(spark, sf_dir):
    tables = A.text_index(spark, sf_dir) | {"notes": A.notes(spark, sf_dir)}
    views, text = fulltext.match_views(tables, "SELECT count(*) AS hits, sum(score) AS score, count(*) FILTER (WHERE snippet LIKE '%**%') AS marked FROM note_match('worthless')")
    return sqlgate.frame(spark, views, text)


@query("sql_text_match", f"SELECT rel_path, score, snippet FROM ({snippet_sql(match_sql([('of the', ['body'], False), ('src3', ['domain'], False)], 'h0 AND NOT h1', [0]), [['of the']])})")
def sql_text_match(spark, sf_dir):
    tables = A.text_index(spark, sf_dir) | {"notes": A.notes(spark, sf_dir)}
    views, text = fulltext.match_views(tables, "SELECT rel_path, score, snippet FROM text_match('body : \"of the\" NOT domain : src3')")
    return sqlgate.frame(spark, views, text)


for _name, _sql in _PASS.items():
    _pass_through(_name, _sql)
