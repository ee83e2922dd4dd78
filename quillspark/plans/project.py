"""From raw notes to the projection: one parse of each note, then plain selects and explodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import markdown as M
from quillspark.sources.vault import machine_id

_FIELDS = ["status", "repo", "host", "network", "updated", "updated_by"]
SCHEMA = (
    "rel_path string, content_hash string, size bigint, stem string, domain string, title string, type string, summary string, tags string, "
    + ", ".join(f"{f} string" for f in _FIELDS)
    + ", metadata_json string, body string, parse_error string, "
    "relations array<struct<target_stem:string,relation_type:string>>, "
    "services array<struct<name:string,container_prefix:string,ports:string,host:string,network:string,replicas:string,role:string>>, "
    "invariants array<string>, verifications array<string>, wikilinks array<string>, markdown_links array<string>, toc array<string>, "
    "chunks array<struct<breadcrumb:string,preview:string,embed_text:string>>"
)


def parsed_note(rel_path: str, content: str, machine: str) -> dict:
    header, body, error = M.parse_leniently(content)
    text = lambda k, d=None: header[k] if isinstance(header.get(k), str) else d
    stem = rel_path.rsplit("/", 1)[-1].removesuffix(".md")
    tags = header.get("tags")
    kind = text("type", "note")
    return dict(
        rel_path=rel_path, stem=stem, domain=rel_path.split("/")[0] if "/" in rel_path else "", title=text("title", stem), type=kind, summary=text("summary", ""),
        tags=" ".join(t for t in tags if isinstance(t, str)) if isinstance(tags, list) else text("tags", ""), **{f: text(f) for f in _FIELDS},
        metadata_json=json.dumps(header, ensure_ascii=False, separators=(",", ":"), default=str), body=body, parse_error=error,
        relations=[dict(target_stem=t, relation_type=k) for t, k in M.relations(header, body)], services=M.services(rel_path, stem, kind, header, body, machine),
        invariants=M.invariants(header, body), verifications=M.verifications(body), wikilinks=M.wikilinks(content), markdown_links=M.markdown_links(content), toc=M.toc(content),
        chunks=[vars(c) for c in M.chunks(stem, header, body)],
    )


def parse_notes(raw: DataFrame, machine: str | None = None) -> DataFrame:
    """The projection's source: a row a readable note, all parts of it parsed in one Arrow pass."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    machine = machine or machine_id()
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [parsed_note(r["rel_path"], r["content"], machine) | {"content_hash": r["content_hash"], "size": r["size"]} for r in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return raw.where("content is not null").select("rel_path", "content_hash", "size", "content").mapInArrow(run, SCHEMA)


def views(parsed: DataFrame) -> dict[str, DataFrame]:
    """The relational tables over parsed notes."""
    return {
        "file_meta": parsed.select("rel_path", "content_hash", "size"),
        "notes": parsed.select("rel_path", "stem", "domain", "title", "tags", "summary", "body"),
        "entities": parsed.select("rel_path", "stem", "domain", "title", "type", "summary", *_FIELDS[:4], "tags", *_FIELDS[4:], "metadata_json"),
        "services": parsed.select(F.explode("services").alias("s"), "rel_path").select("s.*", "rel_path"),
        "relations": parsed.select(F.col("rel_path").alias("source_rel"), F.explode("relations").alias("r")).select("source_rel", "r.*"),
        "invariants": parsed.select(F.col("rel_path").alias("source_rel"), F.explode("invariants").alias("invariant_text")),
        "verifications": parsed.select(F.col("rel_path").alias("source_rel"), F.explode("verifications").alias("command")),
        "chunks": parsed.select("*", F.posexplode("chunks").alias("chunk_index", "c")).select(
            F.concat_ws(":", "rel_path", F.col("chunk_index").cast("string")).alias("chunk_id"), "rel_path", "stem", "domain",
            F.col("title").alias("display_title"), F.col("summary").alias("display_summary"), "tags", "c.breadcrumb",
            F.col("chunk_index").cast("bigint").alias("chunk_index"), F.size("chunks").cast("bigint").alias("total_chunks"), "c.preview", "c.embed_text",
        ),
    }
