"""Link audit of a vault: broken links, orphans, notes that their folder's index doesn't reach. All joins are on equal keys."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import markdown as M
from quillspark.functions.layout import ANCHORS, INDEX_NOTES, RECORDS, RECORDS_INDEX
from quillspark.operators.audit import is_external

_UNLISTED = ("01-Daily/", "50-Configs/", "60-Scripts/")


def with_links(raw: DataFrame) -> DataFrame:
    """(rel_path, wikilinks, markdown_links) of readable notes, the latter as (target, path inside the vault or null)."""

    def run(parts):
        import pandas as pd

        for part in parts:
            yield pd.DataFrame(
                {
                    "rel_path": part["rel_path"],
                    "wikilinks": [M.wikilinks(t) for t in part["content"]],
                    "markdown_links": [[{"target": x, "path": inside(p, x)} for x in M.markdown_links(t)] for p, t in zip(part["rel_path"], part["content"])],
                }
            )

    schema = "rel_path string, wikilinks array<string>, markdown_links array<struct<target:string,path:string>>"
    return raw.where("content is not null").select("rel_path", "content").mapInPandas(run, schema)


def inside(source: str, target: str) -> str | None:
    """The path that a relative link from a note names; null if it leaves the vault or is absolute."""
    path = M.percent_decoded(target.split("#")[0] if "#" in target and not target.startswith("#") else target)
    if path.startswith("/"):
        return None
    joined = os.path.normpath(os.path.join(os.path.dirname(source), path))
    return None if joined.startswith("..") else joined


def wikilink_edges(links: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, target, rel_path): rel_path is each note that a link means, null for a broken one.

    The full path first, then the end of a path for targets with a folder, else the stem; all notes of the best kind count."""
    t = F.trim(F.element_at(F.split("target", "#"), 1))
    norm = F.lower(F.regexp_replace(F.regexp_replace(F.translate(t, "\\", "/"), r"^(\./)+", ""), r"\.md$", ""))
    asked = links.select(F.col("rel_path").alias("source"), F.explode("wikilinks").alias("target")).distinct().withColumn("k", norm).where("k <> ''")
    key = F.lower(F.regexp_replace("rel_path", r"\.md$", ""))
    parts = F.split(key, "/")
    n = F.size(parts)
    # every ending of a path is a key, so that the suffix rule is an equi-join too
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.when(i == 1, 0).otherwise(1).alias("kind"), F.array_join(F.slice(parts, i, n), "/").alias("k")))
    known = paths.select("rel_path", F.explode(ends).alias("e")).select("rel_path", "e.kind", "e.k")
    hit = asked.join(known, "k", "left")
    best = hit.groupBy("source", "target").agg(F.min("kind").alias("best"))
    return hit.join(best, ["source", "target"]).where(F.coalesce(F.col("kind") == F.col("best"), F.lit(True))).select("source", "target", "rel_path").distinct()


def plain_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source, target, there): plain links that don't lead outside, the decoded path that each names, and whether a file is there (else null)."""
    plain = links.select(F.col("rel_path").alias("source"), F.explode("markdown_links").alias("l")).select("source", "l.target", "l.path").where(~is_external("target"))
    return plain.join(files.select(F.col("rel_path").alias("path"), F.lit(True).alias("there")), "path", "left")


def audit(raw: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """raw: notes as read. files: (rel_path) of every file in the vault, for plain links."""
    paths = raw.select("rel_path")
    links = with_links(raw)
    wiki = wikilink_edges(links, paths)
    met = plain_links(links, files)
    inbound = wiki.where("rel_path is not null").select("source", "rel_path").unionByName(met.where("there").select("source", F.col("path").alias("rel_path"))).distinct()
    anchor = F.lower("rel_path").isin(*ANCHORS)
    path = F.col("rel_path")
    unlisted = F.lit(False)
    for folder in _UNLISTED:
        index = INDEX_NOTES[folder[:-1]].split("/")[-1]
        unlisted = unlisted | (path.startswith(folder) & (F.lit(folder == "01-Daily/") | ~path.endswith(index)))
    orphans = paths.where(~anchor & ~unlisted).join(inbound, "rel_path", "left_anti")
    indexes = F.create_map(*[F.lit(x) for kv in INDEX_NOTES.items() for x in kv])
    listed = paths.where(~anchor & ~path.startswith("01-Daily/") & ~path.isin(*INDEX_NOTES.values(), RECORDS_INDEX))
    listed = listed.withColumn("index", F.when(path.contains("/"), F.try_element_at(indexes, F.element_at(F.split("rel_path", "/"), 1)))).where("index is not null")
    reach = inbound.select("rel_path", "source").join(listed, "rel_path")
    reached = reach.where((F.lower("source") == "index.md") | (F.col("source") == F.col("index")) | (path.startswith(RECORDS) & (F.col("source") == RECORDS_INDEX)))
    return {
        "broken_wikilinks": wiki.where("rel_path is null").select("source", "target").unionByName(raw.where("error is not null").select(F.col("rel_path").alias("source"), F.concat(F.lit("could not be read: "), "error").alias("target"))),
        "broken_markdown_links": met.where("there is null").select("source", "target").distinct(),
        "orphans": orphans,
        "unindexed": listed.join(reached.select("rel_path").distinct(), "rel_path", "left_anti"),
    }
