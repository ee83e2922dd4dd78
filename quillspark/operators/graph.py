"""Graph questions over an edge table (source_rel, target_stem, relation_type) and notes (rel_path, stem)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.latin import nocase

MOST_DEPTH = 5


def target_stem(text: str) -> str:
    """The stem that a link or path names."""
    text = text.strip()
    if text.startswith("[[") and text.endswith("]]"):
        text = text[2:-2]
    text = text.split("|")[0].split("#")[0].strip()
    if text.endswith(".md"):
        text = text[:-3]
    return text.rsplit("/", 1)[-1].strip()


def keyed(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def edges(relations: DataFrame, notes: DataFrame) -> DataFrame:
    """Relations between stem keys: (from_key, to_key, source_rel, target_stem, relation_type).

    A source stands under its note's stem, so the stem needs no lookup of its own in a traversal."""
    stems = notes.select("rel_path", "stem")
    named = relations.join(stems, F.col("source_rel") == F.col("rel_path"), "left")
    stem = F.coalesce("stem", F.regexp_extract("source_rel", r"([^/]*?)(?:\.md)?$", 1))
    return named.select(nocase(stem).alias("from_key"), nocase("target_stem").alias("to_key"), stem.alias("source_stem"), "source_rel", "target_stem", "relation_type")


def stem_paths(notes: DataFrame) -> DataFrame:
    """(stem_key, rel_path): the first path of each stem."""
    return notes.groupBy(nocase("stem").alias("stem_key")).agg(F.min("rel_path").alias("rel_path"))


def with_paths(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of stems with the path that each stands for; a stem without a note stands for a note at the root."""
    found = rows.withColumn("_key", nocase("stem")).join(stem_paths(notes), F.col("_key") == F.col("stem_key"), "left")
    return found.withColumn("rel_path", F.coalesce("rel_path", F.concat("stem", F.lit(".md")))).drop("_key", "stem_key")


def upstream(relations: DataFrame, target: str) -> DataFrame:
    return relations.where(nocase("target_stem") == keyed(target_stem(target))).select("source_rel", "relation_type")


def downstream(relations: DataFrame, notes: DataFrame, target: str) -> DataFrame:
    stem = target_stem(target)
    own = notes.where(nocase("stem") == keyed(stem)).select(F.col("rel_path").alias("source_rel"))
    found = relations.join(own.distinct(), "source_rel", "left_semi")
    root = relations.where(F.col("source_rel") == f"{stem}.md").join(own, "source_rel", "left_anti")
    return found.unionByName(root).select("target_stem", "relation_type")


def sinks(services: DataFrame, targets: DataFrame) -> DataFrame:
    """Services that belong to one of some stems (stem): by name, by container, or by the note they stand in.

    Three equi-joins on keys instead of one with a three-way OR, so that it stays a hash join at any size."""
    keys = targets.select(nocase("stem").alias("k")).distinct()
    out = services.withColumns({"_name": nocase("name"), "_prefix": nocase("container_prefix"), "_stem": nocase(F.regexp_extract("rel_path", r"([^/]*)\.md$", 1))})
    ways = F.array_distinct(F.array("_name", "_prefix", "_stem"))
    hit = out.withColumn("_row", F.struct(*services.columns)).select("_row", F.explode(ways).alias("k")).join(keys, "k", "left_semi")
    return hit.select("_row").distinct().select("_row.*")


def blast(relations: DataFrame, notes: DataFrame, services: DataFrame, target: str) -> dict[str, DataFrame]:
    """What a change of the target reaches: rows of upstream, downstream and boundary_sinks, none gathered into one row."""
    stem = relations.sparkSession.createDataFrame([(target_stem(target),)], "stem string")
    return {
        "upstream": upstream(relations, target),
        "downstream": downstream(relations, notes, target),
        "boundary_sinks": sinks(services, stem).select("name", "container_prefix", "ports", "host", "network", "rel_path"),
    }


def traverse(links: DataFrame, start: str, depth: int = 2, direction: str = "down") -> DataFrame:
    """Tree rows (path, depth, stem, relation_type, cycle) below a stem: shared nodes repeat, a node that is its own
    ancestor is marked and not expanded. Depth is 1 to 5; each level is one join of the frontier with the edges."""
    depth = max(1, min(MOST_DEPTH, depth))
    if direction not in ("down", "up"):
        raise ValueError(f"unknown direction {direction!r}")
    a, b, name = ("from_key", "to_key", "target_stem") if direction == "down" else ("to_key", "from_key", "source_stem")
    step = links.select(F.col(a).alias("_at"), F.col(b).alias("_to"), F.col(name).alias("_stem"), "relation_type")
    step.createOrReplaceTempView("_quill_edges")
    root = keyed(target_stem(start)).replace("\\", "\\\\").replace("'", "\\'")
    return links.sparkSession.sql(f"""
        WITH RECURSIVE tree(path, keys, at, depth, relation_type, cycle) AS (
          SELECT CAST(array() AS array<string>), array('{root}'), '{root}', 0, CAST('' AS string), false
          UNION ALL
          SELECT array_append(t.path, e._stem), array_append(t.keys, e._to), e._to, t.depth + 1, e.relation_type, array_contains(t.keys, e._to)
          FROM tree t JOIN _quill_edges e ON e._at = t.at
          WHERE NOT t.cycle AND t.depth < {depth}
        )
        SELECT path, depth, element_at(path, -1) AS stem, relation_type, cycle FROM tree WHERE depth > 0""")


def reach(links: DataFrame, start: str, depth: int = 2, direction: str = "down") -> DataFrame:
    """(stem, depth): what can be reached from a stem in at most so many steps (1 to 5), itself at 0, each at its least depth.

    Each round joins only what the round before found first, and keeps a row a stem: paths are never listed, so dense graphs cost
    no more than their edges a round. A stem stands as it is written; writings of other case are rows of their own."""
    if direction not in ("down", "up"):
        raise ValueError(f"unknown direction {direction!r}")
    a, b, name = ("from_key", "to_key", "target_stem") if direction == "down" else ("to_key", "from_key", "source_stem")
    step = links.select(F.col(a).alias("_at"), F.col(b).alias("_to"), F.col(name).alias("_stem")).distinct()
    root = target_stem(start)
    found = links.sparkSession.createDataFrame([(keyed(root), root, 0)], "key string, stem string, depth int")
    for k in range(max(1, min(MOST_DEPTH, depth))):
        near = found.join(step, (F.col("key") == F.col("_at")) & (F.col("depth") == k), "left")
        own = F.struct("key", "stem", "depth")
        new = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("key"), F.col("_stem").alias("stem"), F.lit(k + 1).alias("depth")))
        found = near.select(F.explode(F.array_compact(F.array(own, new))).alias("r")).groupBy("r.key", "r.stem").agg(F.min("r.depth").alias("depth"))
    return found.select("stem", "depth")


def contracts(notes: DataFrame, relations: DataFrame, services: DataFrame, invariants: DataFrame, verifications: DataFrame, path: str | None = None) -> DataFrame:
    """One row a note, or only the note of a path: its fields, ports, relations, dependencies, dependents, invariants and
    verifications, arrays in order.

    A service that only shares the note's name counts if no other note has that stem."""
    lone = notes.groupBy(nocase("stem").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("_key")
    keyed_notes = notes.withColumn("_key", nocase("stem"))
    if path is not None:  # the one note decides what is read of every table
        keyed_notes = keyed_notes.where(F.col("rel_path") == path)
        key = keyed_notes.select("_key").distinct()
        lone = lone.join(key, "_key", "left_semi")
        own = services.withColumn("_k", F.explode(F.array(nocase("name"), nocase("container_prefix"))))
        own = own.join(key, F.col("_k") == F.col("_key"), "left_semi").drop("_k")
        services = own.unionByName(services.where(F.col("rel_path") == path)).distinct()
        into = relations.withColumn("_k", nocase("target_stem")).join(key, F.col("_k") == F.col("_key"), "left_semi").drop("_k")
        relations, invariants, verifications = (x.where(F.col("source_rel") == path) for x in (relations, invariants, verifications))
    else:
        into = relations
    by_path = services.select("rel_path", "name", "ports")
    named = keyed_notes.join(lone, "_key").select("_key", "rel_path")
    by_name = services.select(F.explode(F.array_distinct(F.array(nocase("name"), nocase("container_prefix")))).alias("_key"), "name", "ports", F.col("rel_path").alias("_own"))
    by_name = by_name.join(named, "_key").where(~F.col("_own").eqNullSafe(F.col("rel_path"))).select("rel_path", "name", "ports", "_own").distinct().drop("_own")
    ports = by_path.unionByName(by_name).where("ports <> ''").select("rel_path", F.format_string("%s: %s", "name", "ports").alias("t"))
    gather = lambda rows, key, text, name: rows.groupBy(F.col(key).alias("rel_path")).agg(F.array_sort(F.collect_list(text)).alias(name))
    incoming = into.select(nocase("target_stem").alias("_key"), "source_rel").groupBy("_key").agg(F.array_sort(F.collect_list("source_rel")).alias("dependents"))
    out = keyed_notes.join(incoming, "_key", "left").drop("_key")
    parts = [
        gather(ports, "rel_path", "t", "ports"),
        gather(relations, "source_rel", F.struct("relation_type", F.col("target_stem").alias("target")), "relations"),
        gather(relations, "source_rel", "target_stem", "dependencies"),
        gather(invariants, "source_rel", "invariant_text", "invariants"),
        gather(verifications, "source_rel", "command", "verifications"),
    ]
    for part in parts:
        out = out.join(part, "rel_path", "left")
    return out.withColumns({c: F.coalesce(c, F.expr("array()").cast(out.schema[c].dataType)) for c in ("dependents", "ports", "relations", "dependencies", "invariants", "verifications")})


def names_note(rel_path: str, stem: str, title: str | None, query: str) -> int | None:
    """How a name means a note, as in `resolve`: 0 exact path, 1 path with hyphens for spaces, 2 stem or title, else None."""
    text, path = query.strip().lstrip("/").removesuffix(".md"), rel_path.removesuffix(".md")
    if path in (text, text.replace(" ", "-")):
        return int(path != text)
    key = keyed(text)
    meant = {key, key.replace(" ", "-"), key.replace("-", " ")}
    return 2 if keyed(stem) in meant or title is not None and keyed(title) in meant else None


def resolve(notes: DataFrame, query: str) -> DataFrame:
    """Notes that a name may mean, the best kind of match only: exact path, path with hyphens for spaces, stem or title."""
    text = query.strip().lstrip("/").removesuffix(".md")
    key, hyphened = keyed(text), keyed(text).replace(" ", "-")
    path = F.regexp_replace("rel_path", r"\.md$", "")
    kind = F.when(path == text, 0).when(path == text.replace(" ", "-"), 1)
    kind = kind.when(nocase("stem").isin(key, hyphened, key.replace("-", " ")) | nocase("title").isin(key, hyphened, key.replace("-", " ")), 2)
    hits = notes.withColumn("_kind", kind).where("_kind is not null")
    best = hits.agg(F.min("_kind")).first()[0]
    if best is None:
        return hits.drop("_kind")
    return hits.where(F.col("_kind") == best).orderBy((nocase("stem") == key).desc(), "rel_path").drop("_kind")
