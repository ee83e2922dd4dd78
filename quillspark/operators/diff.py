"""Snapshot difference by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str = "rel_path", mark: str = "content_hash") -> DataFrame:
    """(key, status): added, updated, deleted or unchanged; one full outer join of two narrow frames."""
    a, b = old.select(key, F.col(mark).alias("_old")), new.select(key, F.col(mark).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def counters(changes: DataFrame) -> DataFrame:
    """One row: added, updated (added included), deleted, unchanged, total."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.agg(n("added").alias("added"), n("added", "updated").alias("updated"), n("deleted").alias("deleted"), n("unchanged").alias("unchanged"), n("added", "updated", "unchanged").alias("total"))


def apply(old: DataFrame, new: DataFrame, changes: DataFrame, key: str = "rel_path") -> DataFrame:
    """The next snapshot: rows of unchanged notes as they are, those of changed ones from the new projection."""
    stays = old.join(changes.where("status = 'unchanged'").select(key), key, "left_semi")
    comes = new.join(changes.where("status in ('added', 'updated')").select(key), key, "left_semi")
    return stays.unionByName(comes)
