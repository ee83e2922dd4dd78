"""Spark-first analytics over Markdown vaults and Parquet tables."""
