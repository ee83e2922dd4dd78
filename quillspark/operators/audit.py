"""Quality audits over tables: required fields, links, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that a note of a type must have; fixed values.
REQUIRED = {
    "project": ["title", "date", "type", "tags", "summary", "status"],
    **dict.fromkeys(["system", "daily", "agent", "config", "script", "reference"], ["title", "date", "type", "tags", "summary"]),
}
REQUIRED_OTHERWISE = ["title", "date", "type", "summary"]


def hrefs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, target): every href of a page."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("target"))


def is_external(target: str) -> Column:
    # fixed value: a scheme of two letters or more, or a place in the note itself
    return F.col(target).rlike("^#|^[A-Za-z][A-Za-z0-9+.-]+:")


def broken(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Links (.., target) whose target is no known path, each once."""
    return links.distinct().join(paths.select(F.col("path").alias("target")), "target", "left_anti")


def missing(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that fail a rule, with the names of all rules that they fail."""
    failed = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.withColumn("missing", failed).where(F.size("missing") > 0)
