"""Reciprocal rank fusion and the graph context of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.latin import nocase

RRF_K = 60.0


def ranked(hits: DataFrame, key: str = "rel_path") -> DataFrame:
    """A bounded result list (at most some hundred rows) with ranks from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def rrf(lists: list[DataFrame], limit: int = 10, key: str = "rel_path") -> DataFrame:
    """(key, score) of the best: the sum of 1 / (60 + rank) over the lists, 4 decimals, ties by key."""
    parts = [ranked(x, key).select(key, (1 / (RRF_K + F.col("rank"))).alias("share")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    total = both.groupBy(key).agg(F.sum("share").alias("share")).orderBy(F.desc("share"), key).limit(limit)
    return total.select(key, (F.round(F.col("share") * 10000) / 10000).alias("score"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str], limit: int, text: str, name: str) -> DataFrame:
    """(key, name): up to so many texts a key, in order, as an array."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    kept = rows.withColumn("_i", number).where(F.col("_i") <= limit)
    return kept.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", text))), lambda x: x[text]).alias(name))


def attach_graph(hits: DataFrame, relations: DataFrame, services: DataFrame) -> DataFrame:
    """Hits (few) with up to 5 upstream and 5 downstream relations and 3 services each, as texts."""
    own = F.broadcast(hits.select("rel_path", nocase("stem").alias("stem_key"), "stem").distinct())
    up = relations.select(nocase("target_stem").alias("stem_key"), "source_rel", "relation_type").join(own, "stem_key")
    up = up.withColumn("t", F.format_string("%s (%s)", "source_rel", "relation_type"))
    down = relations.join(own, F.col("source_rel") == own["rel_path"]).withColumn("t", F.format_string("%s (%s)", "target_stem", "relation_type"))
    named = services.select("name", "ports", F.col("rel_path").alias("service_rel"), nocase("name").alias("name_key"), nocase("container_prefix").alias("prefix_key"))
    # the three ways a service can belong to a note are three equi-joins
    ways = [named.join(own, named["name_key"] == own["stem_key"]), named.join(own, named["prefix_key"] == own["stem_key"]), named.join(own, named["service_rel"] == own["rel_path"])]
    sinks = ways[0].unionByName(ways[1]).unionByName(ways[2]).select("rel_path", "name", "ports", "service_rel").distinct()
    sinks = sinks.withColumn("t", F.concat_ws(":", "name", "ports"))
    out = hits
    for part in (
        first_of_each(up, ["rel_path"], ["source_rel", "relation_type"], 5, "t", "upstream"),
        first_of_each(down, ["rel_path"], ["target_stem", "relation_type"], 5, "t", "downstream"),
        first_of_each(sinks, ["rel_path"], ["name", "service_rel", "ports"], 3, "t", "services"),
    ):
        out = out.join(part, "rel_path", "left")
    return out
