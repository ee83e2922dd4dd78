"""List queries over the projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROJECTS = "20-Projects"


def projects(entities: DataFrame, domain: str = PROJECTS, index: str = "moc", ending: str = "-MOC") -> DataFrame:
    """Notes of the domain but its indexes, which their type or the end of their stem tells."""
    from quillspark.functions.latin import like_escaped

    return entities.where((F.col("domain") == domain) & (F.coalesce("type", F.lit("")) != index) & ~F.col("stem").ilike(f"%{like_escaped(ending)}"))


def services(rows: DataFrame) -> DataFrame:
    return rows.orderBy("name", "rel_path")
