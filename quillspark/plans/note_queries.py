"""Queries that parse Markdown notes, here notes written from tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillspark.functions import markdown as M
from quillspark.operators import audit, links, sqlgate
from quillspark.plans import adapters as A
from quillspark.plans.project import parse_notes, views
from quillspark.plans.registry import query

_FROM = "FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_REL, _STEM = "'supplier/' || replace(s_name, '#', '-') || '.md'", "replace(s_name, '#', '-')"


def _views(spark, sf_dir):
    return views(parse_notes(A.markdown_notes(spark, sf_dir), "here"))


@query("note_projection", f"""
SELECT {_REL} AS rel_path, {_STEM} AS stem, 'supplier' AS domain, s_name AS title, 'service' AS type, 'serves ' || n_name AS summary, 'supplier ' || n_name AS tags {_FROM}
UNION ALL SELECT 'nation/' || n_name || '.md', n_name, 'nation', n_name, 'nation', 'in ' || r_name, '' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def note_projection(spark, sf_dir):
    return _views(spark, sf_dir)["entities"].select("rel_path", "stem", "domain", "title", "type", "summary", "tags")


@query("note_relations", f"""
SELECT {_REL} AS source_rel, n_name AS target_stem, unnest(['located_in', 'references']) AS relation_type {_FROM}
UNION ALL SELECT 'nation/' || n_name || '.md', r_name, 'references' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def note_relations(spark, sf_dir):
    return _views(spark, sf_dir)["relations"]


@query("note_services", f"""
SELECT {_STEM} AS name, {_STEM} || '_*' AS container_prefix, s_suppkey || ':80' AS ports, 'here' AS host, 'default' AS network, '1' AS replicas, 'serves ' || n_name AS role, {_REL} AS rel_path {_FROM}""")
def note_services(spark, sf_dir):
    return _views(spark, sf_dir)["services"]


@query("note_invariants", f"SELECT {_REL} AS source_rel, unnest(['key is ' || s_suppkey, 'stays in ' || n_name]) AS invariant_text {_FROM}")
def note_invariants(spark, sf_dir):
    return _views(spark, sf_dir)["invariants"]


@query("note_verifications", f"SELECT {_REL} AS source_rel, 'test ' || s_suppkey || ' -ge 0' AS command {_FROM}")
def note_verifications(spark, sf_dir):
    return _views(spark, sf_dir)["verifications"]


@query("note_chunks", f"""
SELECT {_REL} AS rel_path, CAST(i AS BIGINT) AS chunk_index, CAST(2 AS BIGINT) AS total_chunks, CASE i WHEN 0 THEN s_name ELSE 'Invariants' END AS breadcrumb FROM (SELECT *, unnest([0, 1]) AS i {_FROM})
UNION ALL SELECT 'nation/' || n_name || '.md', 0, 1, '' FROM nation""")
def note_chunks(spark, sf_dir):
    return _views(spark, sf_dir)["chunks"].select("rel_path", "chunk_index", "total_chunks", "breadcrumb")


@query("note_toc", f"SELECT {_REL} AS rel_path, unnest(['L13: # ' || s_name, 'L17: ## Invariants']) AS line {_FROM}")
def note_toc(spark, sf_dir):
    return parse_notes(A.markdown_notes(spark, sf_dir), "here").select("rel_path", F.explode("toc").alias("line"))


@query("note_section", f"SELECT {_REL} AS rel_path, '- stays in ' || n_name AS first_line {_FROM}")
def note_section(spark, sf_dir):
    text = "SELECT rel_path, split(section, '\\n')[1] AS first_line FROM notes, LATERAL sections(content) WHERE lower(title) = 'invariants'"
    return sqlgate.frame(spark, {"notes": A.markdown_notes(spark, sf_dir)}, text)


@query("note_metadata", f"SELECT {_REL} AS rel_path, s_suppkey || ':80' AS port, 'here' AS machine {_FROM}")
def note_metadata(spark, sf_dir):
    e = _views(spark, sf_dir)["entities"]
    return e.select("rel_path", F.expr("try_variant_get(parse_json(metadata_json), '$.ports[0]', 'string')").alias("port"), F.lit("here").alias("machine")).where("port is not null")


@query("note_lint", f"SELECT {_REL} AS rel_path, 'date' AS missing {_FROM}")
def note_lint(spark, sf_dir):
    said = lambda f: F.coalesce(F.get_json_object("metadata_json", f"$.{f}"), F.lit("")) != ""
    e = _views(spark, sf_dir)["entities"]
    return audit.missing(e, {f: said(f) for f in audit.REQUIRED_OTHERWISE}).select("rel_path", F.array_join("missing", ", ").alias("missing"))


def _audit(spark, sf_dir):
    raw = A.markdown_notes(spark, sf_dir)
    return links.audit(raw, raw.select("rel_path"))


@query("note_broken_links", """
SELECT 'nation/' || n_name || '.md' AS source, 'region/' || r_name AS target, 'wikilink' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'nation/' || n_name || '.md', 'missing/' || n_nationkey || '.md', 'markdown' FROM nation""")
def note_broken_links(spark, sf_dir):
    found = _audit(spark, sf_dir)
    return found["broken_wikilinks"].withColumn("kind", F.lit("wikilink")).unionByName(found["broken_markdown_links"].withColumn("kind", F.lit("markdown")))


@query("note_orphans", f"""
SELECT {_REL} AS rel_path {_FROM} UNION ALL SELECT 'nation/' || n_name || '.md' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def note_orphans(spark, sf_dir):
    return _audit(spark, sf_dir)["orphans"]


# --- notes of every awkward kind

_KIND = "s_suppkey % 6"


def _varied(kind: int, *columns: str) -> str:
    name = list(A.VARIED)[kind]
    return f"SELECT '20-Projects/' || s_suppkey || '-{name}.md' AS rel_path, {', '.join(columns)} FROM supplier WHERE {_KIND} = {kind}"


def _all(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _varied_views(spark, sf_dir):
    return views(parse_notes(A.varied_notes(spark, sf_dir), "here"))


@query("varied_headers", _all(
    _varied(0, "'CRLF ' || s_suppkey AS title", "'system' AS type", "'\"007\"' AS number", "NULL AS error"),
    _varied(1, "s_suppkey || '-broken'", "'note'", "NULL", "'the header isn''t valid YAML'"),
    _varied(2, "s_suppkey || '-open'", "'note'", "NULL", "'the header has no closing ''---'''"),
    _varied(3, "s_suppkey || '-Services-Catalog'", "'note'", "NULL", "NULL"),
    _varied(4, "s_suppkey || '-listed'", "'project'", "NULL", "NULL"),
    _varied(5, "s_suppkey || '-long'", "'note'", "NULL", "NULL")))
def varied_headers(spark, sf_dir):
    parsed = parse_notes(A.varied_notes(spark, sf_dir), "here")
    number = F.expr("to_json(named_struct('n', variant_get(try_parse_json(metadata_json), '$.number', 'string')))")
    return parsed.select("rel_path", "title", "type", F.regexp_extract(number, r'"n":(.*)\}', 1).alias("number"), F.col("parse_error").alias("error")).withColumn("number", F.expr("nullif(number, '')"))


@query("varied_services", _all(
    _varied(3, "unnest(['web-' || s_suppkey, 'db-' || s_suppkey]) AS name", "unnest(['web_*', 'db_*']) AS container_prefix", "unnest(['80', '5432']) AS ports", "'default' AS network", "unnest(['2', '1']) AS replicas", "unnest(['serves a|b', 'stores']) AS role"),
    _varied(4, "unnest([s_suppkey || '-listed', 'a' || s_suppkey, 'b' || s_suppkey])", "unnest([s_suppkey || '-listed_*', 'a_*', 'b_*'])", "unnest(['80, 443', '81', '1:1, 2:2'])", "'lan'", "unnest(['1', '1', '3'])", "''")))
def varied_services(spark, sf_dir):
    return _varied_views(spark, sf_dir)["services"].select("rel_path", "name", "container_prefix", "ports", "network", "replicas", "role")


@query("varied_sections", _all(
    _varied(0, "unnest([1, 2]) AS level", "unnest(['Top', 'Work Log!']) AS title"), _varied(1, "1", "'H'"), _varied(3, "1", "'Services'"),
    _varied(5, "unnest([1, 2, 5])", "unnest(['Long', 'Links', 'Deep'])")))
def varied_sections(spark, sf_dir):
    return sqlgate.frame(spark, {"notes": A.varied_notes(spark, sf_dir)}, "SELECT rel_path, level, title FROM notes, LATERAL sections(content)")


@query("varied_toc", _all(
    _varied(0, "unnest(['L6: # Top', 'L10: ## Work Log!']) AS line"), _varied(1, "'L4: # H'"), _varied(3, "'L1: # Services'"), _varied(5, "unnest(['L1: # Long', 'L12: ## Links', 'L14: ##### Deep'])")))
def varied_toc(spark, sf_dir):
    return sqlgate.frame(spark, {"notes": A.varied_notes(spark, sf_dir)}, "SELECT rel_path, line FROM notes, LATERAL toc(content)")


@query("varied_wikilinks", _all(_varied(0, "'in ' || s_suppkey AS target", "'in ' || s_suppkey AS target_stem"), _varied(1, "'kept-' || s_suppkey", "'kept-' || s_suppkey"), _varied(5, "'even'", "'even'")))
def varied_wikilinks(spark, sf_dir):
    return sqlgate.frame(spark, {"notes": A.varied_notes(spark, sf_dir)}, "SELECT rel_path, target, target_stem FROM notes, LATERAL wikilinks(content)")


@query("varied_tables", _varied(3, "unnest([0, 1, 2]) AS row_number", "unnest(['Service / Stack', '**web-' || s_suppkey || '**', '']) AS first") + " UNION ALL " + _varied(3, "3", "'db-' || s_suppkey"))
def varied_tables(spark, sf_dir):
    return sqlgate.frame(spark, {"notes": A.varied_notes(spark, sf_dir)}, "SELECT rel_path, row AS row_number, cells[0] AS first FROM notes, LATERAL md_table_rows(content)")


@query("varied_chunks", _all(
    _varied(0, "unnest([0, 1]) AS chunk_index", "unnest(['Top', 'Work Log!']) AS breadcrumb"), _varied(1, "0", "'H'"), _varied(2, "0", "''"), _varied(3, "0", "'Services'"), _varied(4, "0", "''"),
    _varied(5, "unnest([0, 1, 2, 3, 4])", "unnest(['Long', 'Long', 'Long', 'Long', 'Links'])")))
def varied_chunks(spark, sf_dir):
    notes = A.varied_notes(spark, sf_dir).withColumn("stem", F.regexp_extract("rel_path", r"([^/]*)\.md$", 1))
    return sqlgate.frame(spark, {"notes": notes}, "SELECT rel_path, chunk_index, breadcrumb FROM notes, LATERAL chunks(stem, content)")


# --- links between notes of a vault with an index


@query("note_percent_links", """
SELECT '40-Systems/' || s_suppkey || '.md' AS source, '../20-Projects/' || replace(n_name, ' ', '%20') || '.md' AS target, '20-Projects/' || n_name || '.md' AS path, true AS there FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT '40-Systems/' || s_suppkey || '.md', 'gone%20' || s_suppkey || '.md', '40-Systems/gone ' || s_suppkey || '.md', false FROM supplier
UNION ALL SELECT '20-Projects/' || n_name || '.md', 'Projects-MOC.md#all', '20-Projects/Projects-MOC.md', true FROM nation""")
def note_percent_links(spark, sf_dir):
    raw = A.indexed_notes(spark, sf_dir)
    return links.plain_links(links.with_links(raw), raw.select("rel_path")).select("source", "target", "path", F.coalesce("there", F.lit(False)).alias("there"))


@query("note_unindexed", """
SELECT '20-Projects/' || n_name || '.md' AS rel_path, '20-Projects/Projects-MOC.md' AS "index" FROM nation WHERE n_nationkey % 2 = 1
UNION ALL SELECT '40-Systems/' || s_suppkey || '.md', '40-Systems/Systems-MOC.md' FROM supplier""")
def note_unindexed(spark, sf_dir):
    raw = A.indexed_notes(spark, sf_dir)
    return links.audit(raw, raw.select("rel_path"))["unindexed"].select("rel_path", "index")


# --- rules of text, applied to what each row of a table makes of every case


def _cases(name: str, rule, cases: dict, source: str = "part", key: str = "p_partkey"):
    # in a case and in what the rule must give, @ stands for the row's key
    q = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in cases.items())

    @query(name, f"SELECT replace(a, '@', CAST({key} AS VARCHAR)) AS input, replace(b, '@', CAST({key} AS VARCHAR)) AS output FROM {source}, (VALUES {values}) AS t(a, b)")
    def run(spark, sf_dir):
        applied = F.udf(rule, "string", useArrow=True)
        case = F.explode(F.array(*map(F.lit, cases)))
        rows = A.spread(A.table(spark, sf_dir, source).select(key), key).select(F.col(key).cast("string").alias("k"), case.alias("c"))
        return rows.select(F.replace("c", F.lit("@"), "k").alias("input")).select("input", applied("input").alias("output"))


_cases("rule_literals", lambda t: json.dumps(M.typed(t)), {
    '"@"': '"@"', "'a @'": '"a @"', "00@": '"00@"', "@.10": '"@.10"', "@.5": "@.5", "@.0": "@.0", "+@": '"+@"', "-1@": "-1@", "@": "@", "true@": '"true@"',
    "[a, b@]": '["a", "b@"]', '[@, "x"]': '[@, "x"]', "{a: @}": '{"a": @}', "[a@": '"[a@"', "12345678901234567890@": '"12345678901234567890@"', "@e5": '"@e5"', " @": '" @"', "plain text @": '"plain text @"',
})
_cases("rule_healing", M.colons_quoted, {
    "title: Bad: Note @ # why\r": 'title: "Bad: Note @" # why\r', 'my key: a: b@ "q"': 'my key: "a: b@ \\"q\\""', 'ok: "x: @"': 'ok: "x: @"', "flow: {a: @}": "flow: {a: @}", "list: [a: b, @]": "list: [a: b, @]",
    "- item: x: @": "- item: x: @", "# c: d: @": "# c: d: @", "block: |\n  in: side: @\nend: a: @": 'block: |\n  in: side: @\nend: "a: @"', "sub:\n  k: v: @": 'sub:\n  k: "v: @"', "url: http://x/@": "url: http://x/@",
})
_cases("rule_percent", M.percent_decoded, {"a%20b+@": "a b+@", "%C3%A9@": "é@", "@%zz%4": "@%zz%4", "@%": "@%"})
_cases("rule_headings", M.heading_key, {"🚪 Gate  Keeper @!": "gate keeper @", "Non-Negotiable_X: é@": "non-negotiable_x é@", "## A.B @": "a b @"})
_cases("rule_types", M.inferred_type, {"20-Projects/@.md": "project", "40-Systems/@/b.md": "system", "01-Daily/@.md": "daily", "other/@.md": "note", "INDEX-@.md": "note"})
_cases("rule_stems", M.target_stem, {"[[a/B@|c]]": "B@", "x@#part": "x@", "dir/Note @.md": "Note @", " [[ A@ ]] ": "A@", "a/b@#c|d": "b@"})
_cases("rule_budget", lambda t: M.within_budget(t, 30), {"short @": "short @", "line\n" * 24 + "and @": "line\n" * 24 + "\n[truncated after about 30 tokens]\n"})
_cases("rule_scalars", lambda t: M.joined_text(json.loads(t)), {'["a", null, @, " b "]': "a, @, b", '"x@ "': "x@ ", '{"a": [@]}': '{"a":[@]}', "@": "@"})
