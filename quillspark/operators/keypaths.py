"""Key paths: a value of a service, an entity's header or any note's header, by a dotted path, for a table of paths at once.

`services.NAME.field`, `entities.NAME.key..` and `NAME.key..` are tried in this order, and of a path's beginnings the longest that names
something counts (names may hold dots). All beginnings of all paths meet the names in equi-joins; the value is reached in the header as
a VARIANT, step by step: a key of a map, or else a number into a list. What is left of the path as one key with dots wins over steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.latin import nocase

_FIELDS = ["name", "container_prefix", "ports", "host", "network", "replicas", "role", "rel_path"]


def segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, r"\."), lambda x: F.trim(x)), lambda x: x != "")


def _step(value: Column, key: Column) -> Column:
    """The value under a key, or at an index; SQL's null if there is none, a VARIANT null where null stands."""
    quote = F.when(F.instr(key, "'") > 0, F.lit('"')).otherwise(F.lit("'"))
    named = F.when(~(F.contains(key, F.lit("'")) & F.contains(key, F.lit('"'))), F.call_function("try_variant_get", value, F.concat(F.lit("$["), quote, key, quote, F.lit("]")), F.lit("variant")))
    at = F.when(key.rlike("^[0-9]{1,9}$"), F.call_function("try_variant_get", value, F.concat(F.lit("$["), key, F.lit("]")), F.lit("variant")))
    return F.coalesce(named, at)


def walked(header: Column, keys: Column) -> Column:
    """JSON of what the keys lead to in a JSON header; null if they lead nowhere."""
    whole = F.try_parse_json(header)
    dotted = F.when(F.size(keys) > 1, _step(whole, F.array_join(keys, ".")))
    return F.to_json(F.coalesce(dotted, F.aggregate(keys, whole, _step)))


def _named(rows: DataFrame, header: Column, source: int, **keys: Column) -> DataFrame:
    """(_by, _key, _source, rel_path, _header): the names under which a row is found; by path ('p'), or in any ASCII case ('n')."""
    ways = [F.struct(F.lit("p" if k.startswith("path") else "n").alias("by"), c.alias("key")) for k, c in keys.items()]
    each = rows.select(F.explode(F.array_distinct(F.array(*ways))).alias("w"), F.lit(source).alias("_source"), "rel_path", header.alias("_header"))
    return each.select(F.col("w.by").alias("_by"), F.col("w.key").alias("_key"), "_source", "rel_path", "_header").where("_key IS NOT NULL AND _key <> ''")


def lookup(paths: DataFrame, services: DataFrame, entities: DataFrame) -> DataFrame:
    """(path, source, rel_path, value) for each distinct path (column path) that names something: source is 'services', 'entities' or 'notes';
    value is JSON, null if the rest of the path leads nowhere. Of several notes of one name the best match counts, then the least path."""
    asked = paths.select("path").distinct().withColumn("_all", segments(F.col("path")))
    first = F.lower(F.element_at("_all", 1))
    skip = F.when((F.size("_all") > 1) & F.element_at("_all", 1).isin("services", "entities"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    begun = asked.where(F.size("_all") > 0).select("path", "_all", first.alias("_first"), F.explode(skip).alias("_skip"))
    begun = begun.select("*", F.explode(F.sequence(F.col("_skip") + 1, F.size("_all"))).alias("_n"))
    text = F.array_join(F.slice("_all", F.col("_skip") + 1, F.col("_n") - F.col("_skip")), ".")
    source = F.when(F.col("_skip") == 0, 2).when(F.col("_first") == "services", 0).otherwise(1)
    begun = begun.withColumns({"_text": text, "_want": source})
    plain = F.regexp_replace(F.ltrim(F.trim("_text"), F.lit("/")), r"\.md$", "")
    hyphens, spaces = F.replace(plain, F.lit(" "), F.lit("-")), F.replace(plain, F.lit("-"), F.lit(" "))
    way = lambda by, key, rank: F.struct(F.lit(by).alias("by"), key.alias("key"), F.lit(rank).alias("rank"))
    ways = F.array(way("p", plain, 0), way("p", hyphens, 1), way("n", nocase(plain), 2), way("n", nocase(hyphens), 3), way("n", nocase(spaces), 3))
    tried = begun.select("path", "_all", "_n", "_want", F.explode(ways).alias("w"))
    fields = F.to_json(F.struct(*_FIELDS))
    file = F.regexp_replace("rel_path", r"\.md$", "")
    names = _named(services, fields, 0, name=nocase("name"), prefix=nocase("container_prefix"))
    for number in (1, 2):
        names = names.unionByName(_named(entities, F.col("metadata_json"), number, path=file, stem=nocase("stem"), title=nocase("title")))
    met = tried.join(names, (F.col("w.by") == F.col("_by")) & (F.col("w.key") == F.col("_key")) & (F.col("_want") == F.col("_source")))
    best = F.min_by(F.struct("rel_path", "_source", "_header", "_n", "_all"), F.struct("_source", -F.col("_n"), "w.rank", "rel_path", "_header"))
    found = met.groupBy("path").agg(best.alias("b")).select("path", "b.*")
    rest = F.slice("_all", F.col("_n") + 1, F.size("_all"))
    return found.select("path", F.element_at(F.array(F.lit("services"), F.lit("entities"), F.lit("notes")), F.col("_source") + 1).alias("source"), "rel_path", walked(F.col("_header"), rest).alias("value"))
